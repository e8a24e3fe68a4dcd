"""Whole licence files with their titles, years and holders; notices under published names."""

from daybefore.llm import licenses

READ = {p.stem: p.read_text() for p in licenses.PUBLISHED.glob("*.txt")} if hasattr(licenses, "PUBLISHED") else {}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(docs).collect()}


def test_whole_files_and_titles(spark):
    mit, isc, bsd = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"], licenses.KNOWN["BSD-2-Clause"]
    assert len(READ) >= 16
    cases = [("MIT", f"MIT License\n\nCopyright (c) 2020 Acme, Inc. and its affiliates.\n\n{mit}\n"), ("MIT", f"The MIT License (MIT)\nCopyright © 2013 J. Doe\n{mit}"),
             ("ISC", f"ISC License\n\nCopyright (c) 2019, A. Person <a@b.org>\n\n{isc}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) 2001, X\nAll rights reserved.\n\n{bsd}"),
             ("Apache-2.0", READ["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Acme")),
             ("Apache-2.0", READ["Apache-2.0"].split("   APPENDIX")[0]), ("GPL-3.0", READ["GPL-3.0"].split("            How to Apply")[0]), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2022 Foo\n\n" + READ["BSD-3-Clause"].split("reserved.")[1].replace("\n* Redistributions of", "\n1. Redistributions of").replace("\n* Redistributions in", "\n2. Redistributions in").replace("\n* Neither", "\n3. Neither")),
             *READ.items()]
    out = found(spark, [t for _, t in cases])
    assert [out[i]["licenses"] for i in range(len(cases))] == [[name.removesuffix("-UC")] for name, _ in cases]


def test_notices_under_published_names(spark):
    cases = [("MPL-2.0-notice", "This file is licensed under the Mozilla Public License, v. 2.0."), ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0"), ("LGPL-2.1-notice", "// SPDX-License-Identifier: LGPL-2.1")]
    out = found(spark, ["Own words.\n" + t for _, t in cases])
    assert [out[i]["notices"] for i in range(len(cases))] == [[name] for name, _ in cases]
