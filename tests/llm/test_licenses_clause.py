"""Notices and texts that share a line with a copyright clause."""

import pytest

from daybefore.llm import licenses


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(docs).collect()}


CLAUSES = ["Copyright 2020 Acme. ", "Copyright (c) 2019-2021 Acme Inc. ", "(c) 2020 Jane Q. Doe. All rights reserved. ", "# Copyright © 2020 Acme Ltd. All Rights Reserved. ", "Copyright (c) 2020 Acme "]


@pytest.mark.parametrize("clause", CLAUSES)
def test_copyright_and_notice_on_one_line(spark, clause):
    one_line = " ".join(licenses.KNOWN["MIT"].split())
    out = found(spark, [clause + "Licensed under the Apache License, Version 2.0.", clause + one_line, clause, clause + "Licensed under CC BY-NC 4.0.", one_line])
    assert out[0]["notices"] == ["Apache-2.0-notice"] and out[3]["notices"] == ["CC-BY-NC-4.0-notice"]
    assert out[1]["licenses"] == ["MIT"] and out[1]["text_digest"] == out[4]["text_digest"]
    assert not out[2]["licenses"] and not out[2]["notices"]


def test_other_text_after_a_clause_stays(spark):
    out = found(spark, ["Copyright 2020 Acme. It rains in spring.", "It rains in spring.", "All rights reserved. It rains in spring.", "Copyright 2020 Acme Co. and friends", ""])
    assert out[0]["text_digest"] == out[1]["text_digest"] == out[2]["text_digest"] != out[4]["text_digest"] == out[3]["text_digest"]
