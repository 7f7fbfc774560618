"""What worker processes hold between stages."""

import public_tokenizers
from pyspark.sql import functions as F

from rankforge.llm import bpe_lexicon, positional_index, shared, simhash_copies, toxicity_ssk


def held(spark, folder):
    """How many things this session's worker processes hold (each writes its own count)."""

    def run(batches):
        yield from batches
        shared_now = __import__("rankforge.llm.shared", fromlist=["shared"])
        with open(f"{folder}/{__import__('os').getpid()}", "w") as f:
            f.write(str(len(shared_now._KEPT)))

    spark.range(400).repartition(8).mapInArrow(run, "id long").count()
    return [int(p.read_text()) for p in folder.iterdir()]


def test_workers_hold_one_encoder_and_only_for_its_own_stage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"plain words number {i} stand here and here") for i in range(400)], "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(1, "number 7 stand here")], "item_id long, text string")
    toxic = docs.select("doc_id", F.lit(1).alias("toxic"))
    stages = [lambda: toxicity_ssk.report(docs, toxic), lambda: simhash_copies.near_copies(docs), lambda: positional_index.report(docs, bench)]
    for n, stage in enumerate(stages):
        bpe_lexicon.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
        (before := tmp_path / f"before{n}").mkdir()
        many = sum(held(spark, before))
        stage().collect()
        (after := tmp_path / f"after{n}").mkdir()
        assert sum(held(spark, after)) < many


def test_one_thing_is_kept():
    made = []
    make = lambda: made.append(1) or len(made)
    assert [shared.kept(("a",), make), shared.kept(("a",), make), shared.kept(("b",), make), shared.kept(("a",), make)] == [1, 1, 2, 3]
    shared.released()
    assert not shared._KEPT and shared.kept(("a",), make) == 4
    shared.released()
