"""From catalog pages in a folder to a search: python examples/sync_and_search.py [folder]

Writes two small list pages, runs an incremental sync of one source twice (the second run asks for no more than it must),
refreshes an index in segments by what has changed, and searches it. Nothing is asked of the network."""

import json
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import keyword, segments, sync_run
from tessera.sources import catalog

SOURCE = "tag:nlp"


def item(ref: str, title: str, updated: str, version: int = 1) -> dict:
    return {"ref": ref, "title": title, "tags": ["nlp"], "lastUpdated": updated, "currentVersionNumber": version}


def put(home: Path, pages: list[list[dict]]) -> None:
    folder = home / "pages" / catalog.folder_name(SOURCE, "updated")
    folder.mkdir(parents=True, exist_ok=True)
    for number, page in enumerate(pages, 1):
        (folder / f"{number}.json").write_text(json.dumps(page))


def stored(spark: SparkSession, home: Path):
    """The resources that the sync has stored, as the index takes them."""
    held = sync_run.Store(spark, f"{home}/state").read("resources")
    return sync_run.kept(held.withColumn("id", F.col("source_id")))


def main() -> None:
    home = Path(sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="example-"))
    spark = SparkSession.builder.master("local[2]").appName("example").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = ["sync", "incremental", "--pages", f"{home}/pages", "--source", SOURCE, "--state", f"{home}/state", "--events", f"{home}/events"]

    put(home, [[item(f"o/wind{k}", f"Wind power {k}", "2024-01-01T00:00:00Z") for k in range(20)], [item("o/sea", "Sea level", "2024-01-02T00:00:00Z")]])
    cli.main(run)
    before = stored(spark, home)
    index = segments.SegmentIndex.of(before, f"{home}/index")

    put(home, [[item("o/sea", "Sea level and wind", "2024-02-01T00:00:00Z", 2)] + [item(f"o/wind{k}", f"Wind power {k}", "2024-01-01T00:00:00Z") for k in range(19)]])
    cli.main(run)
    after = stored(spark, home)
    changes = segments.change_feed(segments.snapshot(before), segments.snapshot(after))
    print("changed:", [(r.id, r.change) for r in changes.collect()])
    index = index.refreshed(changes, after)

    words = spark.createDataFrame([(1, "sea"), (1, "wind")], "query_id long, lexeme string")
    print("best:", [(r.id, r.score) for r in index.best_of_any(words, 3).orderBy("rank").collect()])
    page = keyword.keyword_search(after, ["wind -power"], limit=5)
    print("wind without power:", [(r.id, r.title) for r in page.collect()])


if __name__ == "__main__":
    main()
