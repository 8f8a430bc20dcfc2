import os

import pytest

from solweave.llm.tokens import token_size

FOLDER = "/opt/tokenizers"


def test_bytes(spark):
    df = spark.createDataFrame([("aé€",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(token_size("t").alias("n")).collect()] == [6, 0, None]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_vocabularies(spark, name):
    path = os.path.join(FOLDER, name)
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    df = spark.createDataFrame([("hello world, hello <|endoftext|>",), ("",), (None,)], "t string")
    got = [r.n for r in df.select(token_size("t", path).alias("n")).collect()]
    assert got[0] >= 6 and got[1:] == [0, None]
