import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from suffixspark.llm import licenses, lines, rows, warc

DOCS = "doc_id long, text string, h1 string, row string, n_dropped int, text_ string"


def table(spark, rows):
    """Documents with more columns, of names that the operators use."""
    return spark.createDataFrame([(i, t, "a", "b", 3, "c") for i, t in rows], DOCS)


def brute_lines(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(-1 << 63 if i is None else i)
    out = []
    for i, t in rows:
        own, all_ = -1 << 63 if i is None else i, (t or "").split("\n")
        kept = [x for x in all_ if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and own < max(held[key(x)]))]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    r = random.Random(5)
    pool = ["  Hello There  ", "hello there", "HELLO THERE\t", "ÄÖÜ äöü!!!!", "äöü äöü!!!!", "x", "", "y" * 50, " \r", "same words again"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 6)))) for i in range(40)]
    return [*rows, (100, None), (101, ""), (None, "hello there\nhello there"), (3, rows[3][1]), (3, rows[3][1]), (102, "hello there\n" * 500)]


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_line_dedup(spark, sent):
    rows = line_rows()
    out = lines.dedup_lines(table(spark, rows), 10, 5, sent)
    got = sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str)
    assert got == brute_lines(rows, 10, 5)
    assert out.select("row.*").columns == table(spark, rows).columns


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_line_dedup_of_nothing(spark, sent):
    assert lines.dedup_lines(table(spark, []), sent_rows=sent).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, "http://a.example/é x", h, "q", "z") for i, h in rows], "page_id long, url string, html string, key string, first string")


def test_archives_round_trip(spark):
    big = "0123456789é" * 30_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, big), (6, big), (7, "WARC/1.1\r\n\r\nx"), (9, "b\r\n\r\n"), (8, "b\r\n\r\n"), (None, "a"), (1, "a")]
    chunks = warc.round_trip(pages(spark, rows))
    ends = chunks.filter("last").collect()
    sha = lambda t: warc.base32(hashlib.sha1((t or "").encode()).digest())
    got = sorted((r["record_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"] or "") for r in ends)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    first = {"a": 1, "": 3, big: 5, rows[6][1]: 7, rows[7][1]: 8}
    want = sorted((name(i), len((t or "").encode()), sha(t), "response" if first[t or ""] == i else "revisit", "" if first[t or ""] == i else name(first[t or ""])) for i, t in rows)
    assert got == want
    five = sorted(((r["chunk_no"], r["n_bytes"], r["payload_bytes"], r["digest"]) for r in chunks.filter(F.col("record_id") == name(5)).collect()))
    data, done = big.encode(), 0
    for k, (number, n, so_far, digest) in enumerate(five):  # incremental digests
        done += n
        assert (number, so_far, digest) == (k, done, warc.base32(hashlib.sha1(data[:done]).digest())) and n <= warc.CHUNK_BYTES
    assert done == len(data) and len(five) > 1


def test_short_payloads_are_responses(spark):
    rows = [(1, "a"), (2, "a"), (3, "long enough"), (4, "long enough")]
    out = warc.round_trip(pages(spark, rows), min_revisit_bytes=5).filter("last")
    assert sorted(r["record_type"] for r in out.collect()) == ["response"] * 3 + ["revisit"]


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_licenses(spark):
    mit = "\n".join(["Text before.", *[licenses.SENTENCES[k][0] for k in ("MitGrant", "MitNotice", "AsIsMit")]])
    wrapped = "// Licensed under the Apache License,\n// Version 2.0 (the \"License\");\n// you may not use this file except\n// in compliance with the License."
    rows = [(1, mit), (2, wrapped), (3, "Released under the MIT License. And released   under THE mit license!"), (4, None), (5, ""), (6, "No such words."), (7, "Licensed under CC BY-NC 4.0.\n" * 300), (1, mit)]
    out = {r["row"]["doc_id"]: (r["sentences"], r["licenses"]) for r in licenses.scan(table(spark, rows)).collect()}
    assert out[1][1] == ["MIT"] and out[1][0] == ["MitGrant", "MitNotice", "AsIsMit"]
    assert out[2][1] == ["Apache-2.0"]
    assert out[3][1] == ["MIT"]  # "and released ..." is no known sentence
    assert out[4] == out[5] == out[6] == ([], [])
    assert out[7][1] == ["CC-BY-NC-4.0"] * 300
    assert licenses.scan(table(spark, [])).count() == 0


def test_every_license_rule_is_reachable(spark):
    names = {n for n in licenses.SENTENCES}
    assert all(set(seq.split()) <= names for seq, _ in licenses.RULES)
    one = [(i, "\n".join(licenses.SENTENCES[n][0] for n in seq.split())) for i, (seq, _) in enumerate(licenses.RULES)]
    out = {r["row"]["doc_id"]: r["licenses"] for r in licenses.scan(table(spark, one)).collect()}
    assert [out[i] for i in range(len(one))] == [[name] for _, name in licenses.RULES]


MIT = """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """ISC License

Copyright (c) 2020, A. Writer

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE
"""
BSD = """Copyright (c) 2020, A. Writer
All rights reserved

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

{2} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE
"""
GPL3 = """    A program
    Copyright (C) 2020  A. Writer

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def test_wrapped_notices(spark):
    mit, bsd = ["MitRef", "MitGrant", "MitNotice", "AsIsMit", "LiableMit"], ["AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs"]
    commented = "/*\n" + "".join(f" * {x}\n" for x in MIT.split("\n")) + " */\n"
    marks = ["1. 2. 3.", "* * *", "- - -", "1) 2) 3)", "(a) (b) (c)", "• • •"]
    rows = [(0, MIT), (1, MIT.replace("\n", "\r\n")), (2, commented), (3, MIT.replace("\n\n", "\n")), (4, ISC), (5, GPL3), *((10 + i, BSD.format(*m.split())) for i, m in enumerate(marks))]
    rows += [(20, "Licensed under the MIT License\n\n" + GPL3 + "\nSPDX-License-Identifier: MIT"), (21, "The words of the MIT\nLicense are not at a line's ends here.")]
    out = {r["row"]["doc_id"]: (r["sentences"], r["licenses"]) for r in licenses.scan(table(spark, rows)).collect()}
    assert [out[i] for i in range(4)] == [(mit, ["MIT", "MIT"])] * 4
    assert out[4] == (["IscRef", "IscGrant"], ["ISC", "ISC"])
    assert out[5] == (["GplFree", "GplHope", "GplSee"], ["GPL-3.0-or-later"])
    assert [out[10 + i] for i in range(len(marks))] == [(bsd, ["BSD-3-Clause"])] * len(marks)
    assert out[20] == (["MitRef", "GplFree", "GplHope", "GplSee", "MitRef"], ["MIT", "GPL-3.0-or-later", "MIT"])
    assert out[21] == ([], [])


def test_frequent_lines_are_dropped_in_slices_of_a_batch():
    """No array is made of all rows of a batch at once."""
    line = "a line that many of the documents have in common"
    key = xxhash.xxh3_128_intdigest(line.encode())
    h1, h2 = (lines._signed(np.array([x], np.uint64)) for x in (key >> 64, key & lines.U64))
    n = 3 * rows.SLICE + 7
    batch = pa.RecordBatch.from_pylist([{"row": {"doc_id": i}, "doc_id": i, "text": f"{i}\n{line}" if i % 3 else None} for i in range(n)])
    out = list(lines.drop_lines(iter([batch]), h1, h2, np.array([n - 1 - (n - 1) % 3 - 1]), 40))
    assert [x.num_rows for x in out] == [rows.SLICE] * 3 + [7]
    got = [r for x in out for r in x.to_pylist()]
    last = n - 1 - (n - 1) % 3 - 1
    want = [("", 0) if i % 3 == 0 else (f"{i}\n{line}", 0) if i >= last else (str(i), 1) for i in range(n)]
    assert [(r["text"], r["n_dropped"]) for r in got] == want and [r["row"]["doc_id"] for r in got] == list(range(n))
