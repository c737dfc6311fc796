"""Licences (3), quality (6), archives (8), language (9), mixing (10), and the pipeline."""

import gzip
import hashlib

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from compare import compare, connect
from helpers import plain_near_copies, plain_targets, words_of
from pyspark.sql import functions as F

from tabulight.llm import language, licenses, mixing, quality, queries, select, warc
from tabulight.llm.storage import fresh, new_folder

SF = "/root/testdata/sf0.001"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    con = connect("/root/testdata/sf0.01")
    assert compare(spark, con, "/root/testdata/sf0.01", queries.QUERIES[name], queries.ORACLES[name])[0] is None


def test_every_known_sentence_has_a_cue():
    assert all(any(c in s for c in licenses.CUES) for s in licenses.SENTENCES.values())
    assert all(i in licenses.SENTENCES for _, rule in licenses.RULES for i in rule)


def test_licenses(spark, odd, nothing):
    a, b, c = MIT.split("\n\n")
    rows = [(1, f"Prose here.\n{MIT}"), (2, f"{b}\n\n{a}\n\n{c}"), (3, "Ends without stop\nReleased under the MIT License.\nmore"), (4, None), (5, "licensed"),
            (6, "It is LICENSED under   CC BY-NC 4.0!"), (7, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].licenses == ["MIT"] and got[1].sentences == ["mit-grant", "mit-notice", "mit-warranty"]
    assert got[2].licenses == [] and got[2].sentences == ["mit-notice", "mit-grant", "mit-warranty"]     # the order is part of the rule
    assert got[3].licenses == ["MIT"] and got[3].line_sentences == ["mit-short"] and got[3].sentences == []
    assert got[4].licenses == got[5].licenses == got[6].licenses == [] and got[7].licenses == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(nothing).count() == 0
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "BSD-2-Clause": BSD2,
    "BSD-3-Clause": BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.\n",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.\n",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.\n",
    "CC0-1.0": "Licensed under CC0 1.0.\n",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.\n",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "MIT": MIT + "\n",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
}


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_standard_notices(spark, sign):
    assert sorted(NOTICES) == sorted({name for name, _ in licenses.RULES})
    rows = [(name, "".join(f"{sign}{line}\n" for line in text.splitlines())) for name, text in NOTICES.items()]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: ["BSD-2-Clause", name] if name == "BSD-3-Clause" else [name] for name in NOTICES}


@pytest.mark.parametrize("values", [[1.0], [2.0] * 3000, list(range(5000)), [0.1 * (i * 7919 % 3001) for i in range(4000)] + [None, float("nan")]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    order = sorted((v for v in values if v is not None and v == v), reverse=True)
    for k in (0, 1, 2, len(order) // 2, len(order), len(order) + 1):
        assert select.kth_largest(df, "x", k) == (order[k - 1] if 1 <= k <= len(order) else None)


def test_quality_tells_good_from_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.resample(docs, labels)
    assert found.count() == docs.count()
    share = {r.quality: r["share"] for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.95 and share[0] < 0.15
    again = quality.resample(docs.repartition(5), labels)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))
    kept = quality.drawn_only(docs, labels)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()


def test_quality_draws_the_largest(spark, docs, labels):
    rows = quality.resample(docs, labels, concentration=5.0).collect()
    order = sorted((r.drawn_by for r in rows if r.drawn_by is not None), reverse=True)
    kept = [r.drawn_by for r in rows if r.kept]
    assert sorted(kept, reverse=True) == order[: len(kept)] and 0 < len(kept) < len(rows)


def test_quality_scores_are_ratios_of_counts(spark):
    good, bad = "alpha beta gamma", "| # |"
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(20)], "doc_id int, text string")
    ratios = quality.fit(docs, docs.selectExpr("doc_id", "doc_id % 2 AS quality"))
    n = quality.BUCKETS
    # Five n-grams each; good ones are all of the target's, and half of all.
    up, down = np.log(11 / (50 + n)) - np.log(11 / (100 + n)), np.log(1 / (50 + n)) - np.log(11 / (100 + n))
    got = {r.text: r.s for r in docs.select("text", quality.score(F.col("text"), ratios.units).alias("s")).distinct().collect()}
    twice = np.log(21 / (100 + n))
    assert got[good] == pytest.approx(up, abs=1e-5)
    assert got[bad] == pytest.approx((2 * (np.log(1 / (50 + n)) - twice) + 3 * down) / 5, abs=1e-5) and down < ratios.cut < up


def test_quality_of_odd_rows(spark, odd, nothing, labels):
    found = quality.resample(odd, labels.limit(0))
    assert {r.doc_id for r in found.where("not kept").collect()} == {None, 4, 5, 6} and found.count() == odd.count()     # no labels: all that have words
    assert quality.drawn_only(odd, labels.where("doc_id < 0")).columns == odd.columns
    assert quality.resample(nothing, labels).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id bigint, quality int")
    assert quality.resample(odd, none).count() == odd.count()


PAGES = [(1, "http://a/ b", "x" * 1500), (2, None, "x" * 1500), (9, "http://c", "x" * 1500), (3, "http://d", "é" * 40_000), (4, "http://e\r\n", "small"),
         (5, "http://f", "small"), (6, "http://g", None), (7, "http://h", ""), (None, "http://i", "y" * 2000), (8, "http://j", "WARC/1.1\r\n\r\n\r\n\r\n" * 300),
         (10, "http://k", "z" * 999), (11, "http://l", "z" * 999), (12, "http://m", "é" * 40_000), (12, "http://m", "é" * 40_000), (13, "http://n", "w" * 1000),
         (14, "http://n", "w" * 1000)]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS key", "2 AS digest")
    folder = new_folder(spark, "test")
    warc.write(pages, folder, segment=700, chunk=300)
    raw = warc.raw_records(spark, folder)
    assert raw.where("type = 'continuation'").count() > 100 and raw.agg(F.max(F.octet_length("block"))).first()[0] <= 700
    rows = warc.read(spark, folder).collect()
    assert len(rows) == len(PAGES) and all(r.complete for r in rows)
    text = {k: (h or "") for k, _, h in PAGES}
    ids = {r.id: r.row_key for r in rows if r.type == "response"}
    for r in rows:
        payload = text[None if r.row_key is None else int(r.row_key)].encode()
        assert r.digest == hashlib.sha1(payload).hexdigest()
        assert r.payload == payload if r.type == "response" else r.payload is None
    assert sorted((int(r.row_key), int(ids[r.refers])) for r in rows if r.type == "revisit") == [(1, 9), (2, 9), (3, 12), (13, 14)]


def test_archives_that_are_damaged_or_foreign(spark, tmp_path):
    def record(fields, block):
        return warc.record(fields, block) + b"\r\n\r\n"

    body = warc.HTTP + warc.framed(b"0123456789" * 5, 16)
    part = lambda n, block, **more: record([("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", more.pop("own", "<o>") if n == 1 else f"<c{n}>"), (
        "WARC-Segment-Number", str(n)), *([("WARC-Segment-Origin-ID", more.pop("of", "<o>"))] if n > 1 else []), *([("WARC-Segment-Total-Length", str(more["total"]))] if "total" in more else [])], block)
    good = part(3, body[70:], total=len(body)) + part(1, body[:40]) + part(2, body[40:70])
    missing = part(1, body[:40], own="<m>") + part(3, body[70:], of="<m>", total=len(body))
    wrong = part(1, body[:40], own="<w>") + part(2, body[40:], of="<w>", total=len(body) + 1)
    plain = record([("WARC-Type", "response"), ("WARC-Record-ID", "<p>")], b"HTTP/1.1 200 OK\r\n\r\nplain")
    broken = record([("WARC-Type", "response"), ("WARC-Record-ID", "<b>")], warc.HTTP + b"zz\r\nplain")
    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: none")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(good) + gzip.compress(missing))
    (tmp_path / "b.warc").write_bytes(wrong + plain + broken)
    (tmp_path / "c.warc").write_bytes(b"")
    got = {r.id: (bytes(r.payload) if r.payload is not None else None, r.complete) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {"<o>": (b"0123456789" * 5, True), "<m>": (None, False), "<w>": (None, False), "<p>": (b"plain", True), "<b>": (None, False)}


def test_archive_of_no_pages(spark):
    folder = new_folder(spark, "test")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


@pytest.mark.parametrize("payload", [b"", b"a", b"\r\n\r\n0\r\n\r\n", bytes(range(256)) * 9])
def test_chunks(payload):
    assert warc.unframed(warc.framed(payload, 7)) == payload and warc.unframed(warc.framed(payload, 7)[:-6]) is None
    assert warc.unframed(b"4;name=v\r\nabcd\r\n0\r\nTrailer: x\r\n\r\n") == b"abcd"


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and np.mean([r.lang_pred == r.lang for r in found]) > 0.98 and all(0 <= r.score <= 1 for r in found)


def test_unknown_words_fall_back_to_shorter_ngrams(spark):
    rows = [(i, t, lang) for i in range(4) for t, lang in (("schifffahrt heute", "de"), ("ourselves today", "en"))]
    model = language.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    tests = {"heute": "de", "schifffahrten": "de", "ifff": "de", "today!": "en", "OURSELVES": "en", "lve": "en", "v": "en", "": "und", "12": "und", "日": "de", None: "und"}
    got = spark.createDataFrame([(t,) for t in tests], "text string").select("text", language.identify(F.col("text"), model).alias("x")).collect()
    assert {r.text: r.x.lang_pred for r in got} == tests
    score = {r.text: r.x.score for r in got}
    assert score["日"] == 0.5 and score[""] == 0 and score["heute"] > 0.8


def test_languages_of_odd_rows(spark, odd, nothing):
    model = language.learn(odd)
    assert model.languages == ["de", "en", "fr"]
    got = odd.select("doc_id", "text", language.identify(F.col("text"), model)["lang_pred"].alias("p")).collect()
    assert all((r.p == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    kept = language.confident_only(odd, model)
    assert kept.columns == odd.columns and kept.count() < odd.count()
    none = language.learn(nothing)
    assert none.languages == [] and language.confident_only(odd, none).count() == 0 and language.confident_only(nothing, model).count() == 0


def test_mix_meets_its_targets(spark, docs):
    rows = queries.op10_source_mix(spark, "/root/testdata/sf0.01").collect()
    source = {r.doc_id: (r.source, words_of(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes = {}
    for s, n in source.values():
        sizes[s] = sizes.get(s, 0) + n
    goal, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        s, n = source[r.doc_id]
        assert (r["size"], r.source_size) == (n, sizes[s]) and r.target == pytest.approx(goal[s]) and r.taken in (0, n, 2 * n)
        taken[s] += r.taken
    assert len(rows) == len(source) and all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in goal)
    again = queries.op10_source_mix(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_rates_are_exponential_tilts(spark, docs):
    mixed, names = mixing.mix(docs)
    rows = mixed.collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s and 0 < r[names[3]] < 2 and r[names[0]] > 0]
        slope = [np.log(r[names[3]]) / r[names[0]] for r in own]
        assert np.allclose(slope, slope[:1], rtol=1e-9)
        total = sum(r[names[3]] * r[names[0]] for r in rows if r.source == s)
        assert total == pytest.approx(next(r[names[2]] for r in rows if r.source == s), rel=1e-6)


def test_mix_of_odd_rows(odd, nothing):
    mixed, names = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, *names] and not set(names) & set(odd.columns)
    rows = mixed.collect()
    sizes = {}
    for r in odd.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words_of(r.text)
    goal = plain_targets(sizes)
    assert len(rows) == odd.count() and all(r[names[2]] == pytest.approx(goal[r.source]) and r[names[0]] == words_of(r.text) and 0 <= r[names[4]] <= 2 for r in rows)
    assert mixing.repeated(odd).columns == odd.columns and mixing.repeated(odd).count() == sum(r[names[4]] for r in rows)
    assert mixing.mix(nothing)[0].count() == 0 and mixing.mix(odd.where("doc_id in (4, 5, 6)"))[0].count() == 3


@pytest.mark.parametrize("text", ["'same few words'", "concat('text ', id)"])
def test_mix_deals_a_repeated_key_to_many_groups(spark, monkeypatch, text):
    monkeypatch.setattr(mixing, "GROUP", 100)
    table = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS doc_id", f"{text} AS text", "'a' AS source", "'en' AS lang")
    monkeypatch.setattr(mixing, "rounded", lambda rate, size: np.full(len(rate), len(rate), np.int64))
    mixed, names = mixing.mix(table)
    largest = [r[names[4]] for r in mixed.collect()]
    assert len(largest) == 3000 and max(largest) < 200


def test_fresh_names():
    assert fresh(["a", "B"], "a", "b", "b", "c") == ["_a", "_b", "__b", "c"]


def test_pipeline(spark, docs, labels):
    """Every stage against its plain rule, on what the stage before it kept."""
    stage = docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "mixing sources", "SentencePiece encoding"]
    kept = [docs.collect()]
    for _, function in corpus_pipeline.STAGES:
        folder = new_folder(spark, "test")
        function(spark, stage, SF).write.parquet(folder)
        stage = spark.read.parquet(folder)
        kept.append(stage.collect())
    raw, good, spoken, unique, mixed, encoded = kept
    assert all(rows[0].__fields__ == docs.columns for rows in (good, spoken, unique, mixed))
    drawn = {r.doc_id for r in quality.resample(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in good} == drawn and 0.7 * len(raw) < len(good) < len(raw)
    assert {r.doc_id for r in spoken} <= drawn and len(spoken) >= 0.98 * len(good)
    assert sorted(r.doc_id for r in unique) == plain_near_copies([(r.doc_id, r.text) for r in spoken])
    sizes, taken = {}, {}
    for r in unique:
        sizes[r.source] = sizes.get(r.source, 0) + words_of(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + words_of(r.text)
    goal = plain_targets(sizes)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in unique} and abs(sum(taken.values()) - sum(goal.values())) < 0.02 * sum(goal.values())
    model = sentencepiece.SentencePieceProcessor(model_file=queries.public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in mixed}
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed)
    for r in encoded:
        ids = model.encode(text[r.doc_id], add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, encoded))


@pytest.mark.parametrize("rows", ["odd", "nothing"])
def test_pipeline_stages_of_odd_rows(spark, rows, request):
    table = request.getfixturevalue(rows)
    for name, function in corpus_pipeline.STAGES:
        result = function(spark, table, SF)
        assert result.count() <= 2 * table.count()
        assert name.startswith("Sentence") or result.columns == table.columns


def test_parts_of_a_column_are_cut_before_they_are_copied():
    """Rows in order, whole texts, nulls as empty; only a text larger than a part makes a larger one."""
    import pyarrow as pa
    from tabulight.llm.flat import flat_text, text_pieces

    texts = ["a" * 30, None, "", "ü" * 40, "b" * 500, "c", None] * 9
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *texts], kind).slice(1)
        parts = list(text_pieces(column, 100))
        assert b"".join(d.tobytes() for d, _ in parts) == flat_text(column)[0].tobytes()
        sizes = [int(n) for _, o in parts for n in np.diff(o)]
        assert sizes == [len((t or "").encode()) for t in texts] and max(len(d) for d, o in parts if len(o) > 2) <= 100
    assert list(text_pieces(pa.array([], pa.string()))) == []
