"""Lines whose fields have the schema's own types are read in one step, all others field by field."""

import json
import re

from pyspark.sql import functions as F

from helpers import access
from logwarden.schema import raw_schema
from logwarden.sources import documents as D


def test_plain_lines_are_told_by_their_kinds(spark):
    plain = access(1000, "u", "t", log_id=3)
    token = plain["jwt"]
    docs = [plain, {**plain, "uri": None}, {**plain, "jwt": None}, {**plain, "log_id": 2**40},
            {**plain, "bytes_sent": 5}, {**plain, "other": "x"}, {**plain, "jwt": {**token, "aud": "one"}}, {**plain, "jwt": {**token, "ext": {"v": 2**31}}}]
    lines = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, value string")
    kinds = [r.k for r in lines.select("i", F.schema_of_variant(F.try_parse_json("value")).alias("k")).sort("i").collect()]
    pattern = D._plain_kinds(raw_schema())
    assert [bool(re.fullmatch(pattern, k)) for k in kinds] == [True, True, True, True, False, False, False, True]
    got = {r.line: r for r in D.parse_lines(lines).collect()}
    rows = [got[json.dumps(d)] for d in docs]
    assert [r.reason for r in rows] == [None] * 7 + ["unreadable: jwt.ext.v"]
    assert [r.log_id for r in rows[:4]] == [3, 3, 3, 2**40] and rows[1].uri is None and rows[2].jwt is None
    assert rows[4].bytes_sent == "5" and rows[6].jwt.aud == ["one"] and rows[0].jwt.aud == ["https://api.example"]
