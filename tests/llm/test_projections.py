"""Quality rules, licenses, URL filters, sharding: SQL, rules of their contracts, odd rows."""

import random
import re
from collections import Counter

import plain
import pytest
from pyspark.sql import functions as F

from tools.check_oracle import compare, connect
from tracefork.llm import licenses, quality, sharding
from tracefork.llm.queries import URL_RULES, op4_sharding, oracle_sql
from tracefork.llm.tables import table
from tracefork.llm.url_filter import RuleTrie, host_and_path, judge_urls


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(plain.SF), name, plain.SF)[0] == ""


def plain_quality(text):
    words = plain.SPACED.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if plain.SPACED.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(["a ", "b ", "é\n", "\n", "\t#", "c d\n", "𝔘 "], k=rng.randrange(60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").union(plain.odd(spark).select("doc_id", "text"))
    for r in quality.judge_quality(docs).collect():
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain_quality(r.text)
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert not (q.base_failed and q.kept)


def test_clean_texts_of_other_languages_and_of_any_length_stay(spark):
    rng = random.Random(7)
    turkish = "Yağmur bütün gece sürdü ve sabah kasabanın üstünü ince bir sis örttü".split()
    russian = "Утром поезд пришёл вовремя и мы пошли пешком через старый мост к реке".split()
    texts = [" ".join(f"{w}{rng.randrange(99)}" for w in rng.choices(words, k=120)) for words in (turkish, russian)]
    texts.append("the " + " ".join(f"word{i} of" for i in range(600_000)))
    few = "the " + " ".join(f"kx{rng.randrange(10**6)}" for _ in range(200))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, few])], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.quality.kept) for r in quality.judge_quality(docs).collect()) == [(0, True), (1, True), (2, True), (3, False)]


def test_quality_is_one_projection_and_keeps_columns(spark):
    docs = table(spark, plain.SF, "documents").withColumn("quality", F.lit(1))
    plan = quality.judge_quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    good = quality.good_documents(docs)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()


def test_licenses_of_notices_and_whole_texts(spark):
    mit = """Copyright (c) 2020 Someone

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT ..."""
    rows = [
        (1, mit),
        (2, "Text.\nReleased under the MIT License."),
        (3, "Some words. Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."),
        (5, "A text about licenses in general."),
        (6, None),
    ]
    out = {r.doc_id: r.license_scan for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].licenses == ["MIT"] and out[2].license == "MIT" and out[3].licenses == ["CC-BY-NC-4.0"]
    assert out[4].licenses == ["Apache-2.0", "GPL-3.0"] and out[4].license == "Apache-2.0"
    assert out[5].licenses == [] and out[6].license is None
    assert licenses.scan_licenses(plain.odd(spark)).count() == len(plain.ODD)


CONDITIONS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.
"""
HOPE = """
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
MIT_REST = """
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT ...
"""
PUBLISHED = [
    ("MIT", GRANT + MIT_REST),
    ("MIT", GRANT),
    ("MIT", "MIT License\n"),
    ("GPL-3.0", GPL.format(":", ",", 3) + HOPE),
    ("GPL-3.0", GPL.format(":", ",", 3)),
    ("GPL-2.0", GPL.format(";", ";", 2) + HOPE),
    ("GPL-2.0", GPL.format(";", ";", 2)),
    ("BSD-2-Clause", CONDITIONS),
    ("BSD-3-Clause", CONDITIONS + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""),
    *[(f"CC-{k.upper()}-4.0", f"This work is licensed under a Creative Commons Attribution{x} 4.0\nInternational License.\n")
      for k, x in (("by", ""), ("by-sa", "-ShareAlike"), ("by-nc", "-NonCommercial"))],
]


def test_published_texts_in_comments_and_with_other_line_ends(spark):
    assert {name for name, _ in PUBLISHED} == {name for name, _ in licenses.RULES}
    assert all(re.search(licenses.SIGNS, s) for s in licenses.sentence_ids())
    rows = []
    for name, text in PUBLISHED:
        whole = f"Copyright (C) 2020 Someone\n\n{text}\nint main;\n"
        for mark in ("", " * ", "# ", "// ", "dnl ", "REM ", ";; "):
            marked = re.sub("(?m)^", mark, whole) if mark else whole
            rows += [(name, x) for x in (marked, re.sub("(?m) +$", "", marked), marked.replace("\n", "\r\n"))]
        rows.append((name, f"/*\n{re.sub('(?m)^', ' * ', whole)} */\ncode"))
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "name string, text string")).collect():
        assert r.license_scan.licenses == [r.name] and r.license_scan.license == r.name, r


def test_url_parts_and_longest_match():
    assert host_and_path("HTTP://A.Example.ORG/En/1?x#y") == ("a.example.org", "/En/1")
    assert host_and_path(None) == host_and_path("no scheme") == ("", "")
    assert host_and_path("http://h#f/x") == ("h", "")
    trie = RuleTrie([*URL_RULES, ("allow", "x.com", "/de/ok"), ("block", "x.com", "/de/ok"), ("block", "net", "/")])
    assert trie.find("www.example.org", "/en/12") == ("example.org/en/1", "block")
    assert trie.find("www.example.org", "/en/2") == ("org/", "allow")
    assert trie.find("notexample.org", "/es/") == ("org/", "allow")
    assert trie.find("a.com", "/de/x") == ("com/de/", "block") and trie.find("a.com", "/de") is None
    assert trie.find("x.com", "/de/okay") == ("x.com/de/ok", "block")
    assert trie.find("org", "") is None and trie.find("", "") is None


def test_trie_against_all_rules():
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "org", "c.org"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), "/" + "".join(rng.choices("ab/", k=rng.randrange(4)))) for _ in range(25)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    trie = RuleTrie(rules)
    for _ in range(400):
        host, path = rng.choice(hosts + ["x.b.a.com", "xcom", "d.org"]), "/" + "".join(rng.choices("ab/", k=rng.randrange(6)))
        fits = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert trie.find(host, path) == (max(fits)[2:] if fits else None)


def test_urls_with_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "http://example.org/es/", "z")]
    out = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string"), URL_RULES)
    assert out.columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict"]
    assert [r.verdict for r in out.orderBy("page_id").collect()] == ["allow", "allow", "allow", "block"]
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).collect() == []


def check_shards(rows, sizes, shards=8):
    held = Counter()
    for r in rows:
        held[r.shard] += r.size
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sum(held.values()) == sum(sizes)
    fair = sum(sizes) / shards
    assert all(abs(held[s] - fair) <= max(sizes) for s in range(shards))


def test_shards_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, plain.SF, "documents").collect()}
    rows = op4_sharding(spark, plain.SF).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    import zlib

    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    check_shards(rows, [r.size for r in rows])


def test_a_hot_group_of_equal_texts_is_divided(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot"), 20)).otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(docs).collect()
    check_shards(rows, [r.size for r in rows])


def test_odd_documents_shard(spark):
    rows = sharding.shard(plain.odd(spark)).collect()
    assert len(rows) == len(plain.ODD)
    check_shards(rows, [r.size for r in rows])
    assert sharding.shard(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
