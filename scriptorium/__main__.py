"""``python -m scriptorium -o OUT (--local-folder DIR | --trees ROOT)``: structure papers and write their folders."""

from __future__ import annotations

import argparse
import sys

from scriptorium.operators import record as R
from scriptorium.plans.scratch import Scratch
from scriptorium.plans.session import local_session
from scriptorium.sources import files as S
from scriptorium.sources.folder_view import write_folder_view


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="scriptorium")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--local-folder", help="one paper's source tree")
    which.add_argument("--trees", help="a folder with one tree for each paper")
    p.add_argument("-o", "--output", required=True, help="a folder that all executors share")
    p.add_argument("--parquet", help="also write the records as Parquet")
    p.add_argument("--no-macros", action="store_true", help="don't expand the papers' own macros")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = local_session("*")
    single = R.paper_id_of(a.local_folder) if a.local_folder else None
    trees = S.scan_trees(spark, a.trees or a.local_folder, paper_id=single)
    papers = S.prepared(S.flattened(trees), macros=not a.no_macros)
    bibs = S.bib_files(trees).select("paper_id", "file", "size", "content")
    scratch = Scratch(spark, "cli")
    records = scratch.keep(R.digest(papers, bibs), "records")
    if a.parquet:
        records.write.mode("overwrite").parquet(a.parquet)
    asked = trees.select("paper_id").distinct().count()
    written = write_folder_view(records, a.output).count()
    print(f"{written} of {asked} papers written to {a.output}")
    return 0 if written == asked and written else 1


if __name__ == "__main__":
    sys.exit(main())
