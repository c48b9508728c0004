import base64
import os

import public_tokenizers
import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture
def documents(spark):
    """Makes documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows):
        return spark.createDataFrame([(*r, "en", "s0")[:4] if len(r) == 2 else r for r in rows], SCHEMA)
    return make


@pytest.fixture
def write_tables(spark, tmp_path):
    """Writes tables as parquet and gives the folder, as queries read it."""
    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(os.path.join(str(tmp_path), f"{name}.parquet"))
        return str(tmp_path)
    return write


@pytest.fixture(scope="session")
def tiktoken_50k():
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
