"""The language stage of the pipeline rejects by the classifier's own evidence."""

import random
import string

from citeweave.llm import langid

SF = "/root/testdata/sf0.01"


def test_gibberish_and_unknown_scripts_go(spark):
    draw = random.Random(6)
    odd = [(10_000_000 + i, "".join(draw.choice(string.ascii_lowercase + " ") for _ in range(300)) + "q", "en") for i in range(20)]
    odd += [(20_000_000 + i, "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(100)), "en") for i in range(20)]
    odd += [(30_000_000, "12 34 .. !", "en"), (30_000_001, None, "en"), (30_000_002, "", "en")]
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(documents)
    kept = {r.doc_id for r in langid.with_language(documents.union(spark.createDataFrame(odd, documents.schema)), model).collect()}
    assert kept == {r.doc_id for r in documents.collect()}
    assert langid.Model([], None, None).explains(["some text", None]) == [False, False]
