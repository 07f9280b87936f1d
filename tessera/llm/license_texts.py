"""Names and notices of licences, whole texts of the short ones, and how the files of the long ones begin, as
their authors publish them."""

from __future__ import annotations

#: Identifier and the names by which a licence is referred to.
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("the Apache License, Version 2.0", "Apache License 2.0")),
    ("MIT", ("the MIT License",)),
    ("BSD-2-Clause", ("the BSD 2-Clause License",)),
    ("BSD-3-Clause", ("the BSD 3-Clause License",)),
    ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3")),
    ("LGPL-2.1", ("the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "the GNU AGPL v3")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0",)),
    ("EPL-2.0", ("the Eclipse Public License 2.0",)),
    ("CC0-1.0", ("CC0 1.0 Universal", "the Creative Commons Zero v1.0 Universal license")),
    ("ISC", ("the ISC License",)),
    ("Zlib", ("the zlib License",)),
    ("BSL-1.0", ("the Boost Software License, Version 1.0",)),
)
#: Creative Commons licences: each kind with its long name, in each version.
CC_KINDS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: What is said of a name.
PHRASES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.")

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU_GRANT = (
    "{this} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {version} of the License, or "
    "(at your option) any later version."
)
_GNU_REST = (
    " {this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {kind} for more details."
)
_GNU_FILE = "GNU {kind} Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: The same with the address that files of older versions have.
_GNU_OLD = "GNU {kind} Version {version} Copyright (C) Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, kind: str, version: str, this: str = "This program") -> tuple[tuple[str, str], ...]:
    """The notice with and without its disclaimer."""
    return tuple((name, text.format(this=this, kind=kind, version=version)) for text in (_GNU_GRANT, _GNU_GRANT + _GNU_REST))


#: Notices of files and whole texts of licence files.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT + " " + _MIT_REST),
    ("MIT", _MIT_GRANT),
    ("BSD-2-Clause", " ".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_TAIL))),
    ("BSD-3-Clause", " ".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_TAIL))),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    *_gnu("GPL-2.0", "General Public License", "2"),
    *_gnu("GPL-3.0", "General Public License", "3"),
    *_gnu("LGPL-2.1", "Lesser General Public License", "2.1", "This library"),
    *_gnu("LGPL-3.0", "Lesser General Public License", "3"),
    *_gnu("AGPL-3.0", "Affero General Public License", "3"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "Copyright. All rights reserved."),
    ("proprietary", "All rights reserved."),
)


#: How licence files begin: the licence is that of the directory, however long the rest of the file is.
HEADS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("GPL-1.0", _GNU_OLD.format(kind="GENERAL PUBLIC LICENSE", version="1, February 1989")),
    ("GPL-2.0", _GNU_FILE.format(kind="GENERAL PUBLIC LICENSE", version="2, June 1991")),
    ("GPL-2.0", _GNU_OLD.format(kind="GENERAL PUBLIC LICENSE", version="2, June 1991")),
    ("GPL-3.0", _GNU_FILE.format(kind="GENERAL PUBLIC LICENSE", version="3, 29 June 2007")),
    ("LGPL-2.0", _GNU_OLD.format(kind="LIBRARY GENERAL PUBLIC LICENSE", version="2, June 1991")),
    ("LGPL-2.1", _GNU_FILE.format(kind="LESSER GENERAL PUBLIC LICENSE", version="2.1, February 1999")),
    ("LGPL-2.1", _GNU_OLD.format(kind="LESSER GENERAL PUBLIC LICENSE", version="2.1, February 1999")),
    ("LGPL-3.0", _GNU_FILE.format(kind="LESSER GENERAL PUBLIC LICENSE", version="3, 29 June 2007")),
    ("AGPL-3.0", _GNU_FILE.format(kind="AFFERO GENERAL PUBLIC LICENSE", version="3, 19 November 2007")),
    ("GFDL-1.2", _GNU_FILE.format(kind="Free Documentation License", version="1.2, November 2002")),
    ("GFDL-1.2", _GNU_OLD.format(kind="Free Documentation License", version="1.2, November 2002")),
    ("GFDL-1.3", _GNU_FILE.format(kind="Free Documentation License", version="1.3, 3 November 2008")),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 --------------- 1. Definitions. 1.0.1. \"Commercial Use\" means distribution or otherwise making the Covered Code available to a third party."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."),
    (
        "CC0-1.0",
        "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.",
    ),
    ("Artistic-1.0", 'The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package.'),
)


def templates() -> tuple[tuple[str, str], ...]:
    """(identifier, text) of every template: phrases of all names, identifiers in SPDX form, and notices."""
    names = list(NAMES)
    for kind, long in CC_KINDS:
        names += [(f"CC-{kind}-{v}", (f"CC {kind} {v}", f"a Creative Commons {long} {v} {'International' if v == '4.0' else 'Unported'} License")) for v in CC_VERSIONS]
    said = [(i, phrase.format(full)) for i, fulls in names for full in fulls for phrase in PHRASES]
    spdx = [(i, f"SPDX-License-Identifier: {i}") for i, _ in names]
    return (*said, *spdx, *NOTICES, *HEADS)
