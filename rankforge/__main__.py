"""Command line: ``python -m rankforge demo | inspect-dataset | list-systems | run | compare | evaluate``."""

from __future__ import annotations

import argparse
import os
import sys

from rankforge import __version__


def _session():
    from pyspark.sql import SparkSession

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = SparkSession.builder.appName("rankforge").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):  # on a cluster its own settings hold
        spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return spark


def inspect(spark, docs: str, questions: str, qrels: str | None) -> dict:
    """Counts of documents, questions (by answerability and category) and labels."""
    from pyspark.sql import functions as F

    from rankforge.sources import documents

    asked = documents.read_questions(spark, questions)
    total = asked.agg(F.count("*").alias("questions"), F.count_if(F.size("relevant_doc_ids") > 0).alias("answerable")).first()
    kinds = {r["category"]: r["count"] for r in asked.groupBy("category").count().orderBy("category").collect()}
    return {"documents": documents.read_documents(spark, docs).count(), "questions": total["questions"], "answerable": total["answerable"], "unanswerable": total["questions"] - total["answerable"], "qrels": documents.read_qrels(spark, qrels, asked).count(), "categories": kinds}


def live_generators(path: str) -> dict:
    """Generators of the models that an experiment file names, if MODEL_API_URL says where they are."""
    from rankforge.operators import models
    from rankforge.sources import experiment

    url = os.environ.get("MODEL_API_URL")
    plan = experiment.load_experiment(path)
    names = {s.models.get("generator") for s in plan.systems} | {plan.evaluation.judge_model}
    return {n: models.chat_generator(n, url) for n in names if n} if url else {}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("rankforge", description=__doc__)
    top.add_argument("--version", action="version", version=f"rankforge {__version__}")
    sub = top.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo", help="write the demo data set")
    demo.add_argument("-o", "--output", default="data/demo")
    demo.add_argument("--overwrite", action="store_true")
    look = sub.add_parser("inspect-dataset", help="count documents, questions and labels")
    for name in ("docs", "questions"):
        look.add_argument(f"--{name}", required=True)
    look.add_argument("--qrels")
    sub.add_parser("list-systems", help="types of systems")
    for name in ("run", "compare", "evaluate"):
        go = sub.add_parser(name, help="run an experiment file")
        go.add_argument("-c", "--config", required=True)
        go.add_argument("--mock", action="store_true", help="work offline even if MODEL_API_URL is set")
        go.add_argument("--max-workers", type=int, help="accepted; Spark decides how many questions are answered at once")
    args = top.parse_args(argv)
    if args.command == "demo":
        from rankforge.sources.demo import write_demo

        made = write_demo(args.output, args.overwrite)
        print(f"{args.output}: {made['documents']} documents, {made['questions']} questions, {made['qrels']} labels")
    elif args.command == "list-systems":
        from rankforge.operators.systems import SYSTEMS

        print("\n".join(f"{name}: {f.__name__}" for name, f in sorted(SYSTEMS.items())))
    elif args.command == "inspect-dataset":
        for name, value in inspect(_session(), args.docs, args.questions, args.qrels).items():
            print(f"{name}: {value}")
    else:
        from rankforge.operators.evaluation import run
        from rankforge.sources.experiment import load_settings

        load_settings(args.config)
        live = {} if args.mock else live_generators(args.config)
        if not live:
            print("offline: answers are extractive and judged by rules; scores only check the pipeline")
        print(f"results: {run(_session(), args.config, live)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
