"""The operators in DataFrame functions: licences, mixing and URL rules."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from weirflow.llm import licenses, mixing, url_rules
from weirflow.llm.queries import URL_RULES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_licenses(spark, awkward, empty):
    texts = {
        1: "Some text.\nLicensed under the Apache License, Version 2.0.\nmore",
        2: "LICENSED under the Apache License, Version 2.0. You may not use this file except in compliance with the License! You may obtain a copy of the License at\nSee the License for the specific language governing permissions and limitations under the License",
        3: "Released under the MIT License.\nReleased under the MIT License.",
        4: "You may obtain a copy of the License at",
        5: None,
        6: "",
        7: "Redistributions in binary form must reproduce the above copyright notice\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nThis work is licensed under the GNU General Public License, version 3.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scanned = licenses.scan_licenses(df)
    assert {r.doc_id: r.license for r in scanned.collect()} == {1: "Apache-2.0", 2: "Apache-2.0", 3: "MIT", 4: "unknown", 5: "none", 6: "none", 7: "GPL-3.0"}
    assert {r.doc_id: r.sentence_ids for r in scanned.collect()}[2] == "ApacheLic,ApacheUse,ApacheCopy,ApacheSee"
    assert licenses.scan_licenses(awkward).where("license <> 'none'").count() == 0 and licenses.scan_licenses(empty).count() == 0
    assert "Python" not in plan_of(scanned) and "Exchange" not in plan_of(scanned)


def fill(sizes, weights, total, epochs=3):
    """Targets by the definition: share, cut at the caps, share again."""
    capped = {}
    while True:
        free = [s for s in sizes if s not in capped]
        left, weight = total - sum(capped.values()), sum(weights[s] for s in free)
        over = [s for s in free if Fraction(left * weights[s], weight) > epochs * sizes[s]] if free else []
        if not over:
            return {s: capped[s] if s in capped else Fraction(left * weights[s], weight) for s in sizes}
        capped |= {s: epochs * sizes[s] for s in over}


def test_water_filling(spark):
    rng = random.Random(0)
    for _ in range(12):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 300, 5000]) for i in range(rng.randint(1, 9))}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: (r.weight, r.target) for r in mixing.water_fill(mixing.cycled_weights(df)).collect()}
        weights = {s: w for s, (w, _) in got.items()}
        assert weights == {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
        want = fill(sizes, weights, sum(sizes.values()))
        assert all(abs(t - want[s]) < 1e-6 for s, (_, t) in got.items())


def plain_mix(rows, seed=7):
    """How often each of ``rows`` (doc_id, text, source) is taken, by the definition: all documents of
    a source in the order of slot and draw; one is taken if at least half of it is wanted."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]

    def draw(doc_id, text):
        inner = hashlib.md5((text or "").encode()).hexdigest()
        return int(hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}|{inner}".encode()).hexdigest()[:15], 16)

    draws = [draw(i, t) for i, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    targets = fill(total, {s: i % 3 + 1 for i, s in enumerate(sources)}, sum(total.values()))
    out = [0] * len(rows)
    for s in sources:
        if not total[s]:
            continue
        whole, part = divmod(targets[s], total[s])
        groups = {}
        for i, r in enumerate(rows):
            if r[2] == s:
                out[i] = int(whole)
                if size[i]:
                    groups.setdefault((draws[i] % 4096, draws[i]), []).append(i)
        slots = {}
        for (slot, _), g in groups.items():
            slots[slot] = slots.get(slot, 0) + sum(size[i] for i in g)
        done = 0
        for slot in sorted(slots) if part else ():
            inside, running = done + slots[slot] >= part, done
            for key in sorted(k for k in groups if k[0] == slot):
                running += sum(size[i] for i in groups[key])
                if not inside or any(running - Fraction(size[i], 2) <= part for i in groups[key]):
                    for i in groups[key]:
                        out[i] += 1
            done += slots[slot]
            if inside:
                break
    return out


def test_mixing_by_the_definition(spark, awkward, monkeypatch):
    rng = random.Random(12)
    for n, slots in ((7, 4096), (400, 4096), (3000, 4096)):
        rows = [(rng.choice([None, i, i, i]), rng.choice([None, "", " ".join(["w"] * rng.randint(1, 40)), f"w {i}"]), rng.choice(["a", "b", "é", None, f"s{i % 20}"])) for i in range(n)]
        rows += rows[:5] * 3
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("text",)).collect()
        want = plain_mix(rows)
        assert sorted(str((r.doc_id, r.text, r.source, r.times)) for r in got) == sorted(str((*r, t)) for r, t in zip(rows, want, strict=True))


def test_mixing_sorts_a_part_of_a_slot(spark, monkeypatch):
    """Many documents in one slot: the border is found among its parts."""
    rng = random.Random(13)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9)), rng.choice("ab")) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    every = mixing.mix(df).groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    monkeypatch.setattr(mixing, "SLOTS", 4)
    few = mixing.mix(df).groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    assert len(few) == 2 and all(abs(r.taken - r.target) <= 5 for r in [*every, *few])


def test_mixing(spark, awkward, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "é", None]) if i % 50 else "rare") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    taken, size, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.times <= 3
        taken[r.source] += r.times * r.size
        size[r.source] += r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.target <= 3 * r.source_size
    assert len(got) == 2000 and abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert mixing.mix(awkward, keep=("text", "lang")).count() == awkward.count()
    assert mixing.mix(empty).count() == 0
    twice = mixing.repeated(spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id long, times long"))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 1, 3]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "://x", "https://EXAMPLE.org/ES/", "http://a.example.org/es/x?y#z", "http://example.org/en/12", "http://example.org", "http://com/fr/", "http://x.com?/fr/", "http://notcom/fr/", "a://b://c/d", "http://example.org/es/" + "x" * 5000]
    urls += ["http://" + ".".join(rng.choice(["a", "b", "org", "com", "example"]) for _ in range(rng.randint(1, 5))) + "".join("/" + rng.choice(["es", "en", "1", "fr", "de"]) for _ in range(rng.randint(0, 4))) for _ in range(500)]
    rules = [*URL_RULES, ("example.org", "/en/1", "allow"), ("org", "/es/en", "block"), ("a.com", "/", "block"), ("a.com", "/fr/de", "allow"), ("a.com", "/fr", "allow"), ("b", "", "block")]
    own = sorted(set(rules) - {("example.org", "/en/1", "allow")})
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    judged = url_rules.judge_urls(pages, frame)
    got = {r.page_id: tuple(r)[1:] for r in judged.collect()}
    assert got == {i: judge(u, own) for i, u in enumerate([*urls, *urls])}
    assert url_rules.judge_urls(pages.limit(0), frame).count() == 0
    assert url_rules.judge_urls(pages, frame.limit(0)).where(F.col("rule").isNotNull() | (F.col("verdict") != "allow")).count() == 0
    assert "Python" not in plan_of(judged) and "Cartesian" not in plan_of(judged) and "NestedLoop" not in plan_of(judged)


def test_url_rules_at_the_edges_of_intervals(spark):
    """Hosts and paths that sort next to a rule's interval, of any length and depth."""
    rng = random.Random(11)
    labels = ["org", "example", "example-x", "exam", "", "a", "z-", "\u00e9", "\U0010ffff", "!", "~"]
    parts = ["/es/", "/es", "/", "\U0010ffff", "\ud7ff", "\ue000", "e", "es0", "%", "~"]
    urls = ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 6))) + "/" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(700)]
    urls = [u for u in urls if not any("\ud800" <= c <= "\udfff" for c in u)]
    urls += ["http://example.org/es/\U0010ffffx", "http://example.org./es/", "http://.example.org/es/", "http://" + "a." * 50_000 + "example.org/es/x", "http://example.org/" + "es/" * 50_000]
    rules = [*URL_RULES, ("example.org", "/es/\U0010ffff", "allow"), ("a.org", "/", "block"), ("a.example.org", "/es", "allow"), ("org", "/e", "block"), ("z-.org", "", "block"), ("\U0010ffff", "/", "block"), ("a..org", "/", "block")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        assert got[i] == judge(u, rules), u[:200]
    assert got[urls.index("http://example.org/es/\U0010ffffx")][2:] == ("example.org/es/\U0010ffff", "allow")


def test_url_rules_over_many_ranges(spark):
    """More ranges than keys or than events: state is carried from range to range."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        urls = [f"http://h{i % 7}.com/{'fr' if i % 3 else 'de'}/{i}" for i in range(400)] + ["http://hot.com/fr/"] * 400
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        judged = url_rules.judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
        assert {r.page_id: tuple(r)[1:] for r in judged.collect()} == {i: judge(u, URL_RULES) for i, u in enumerate(urls)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


PUBLISHED_TEXTS = {
    "Apache-2.0": """/*
 * Copyright 2020 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */""",
    "MIT": """MIT License

Copyright (c) 2020 The Authors

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "BSD": """Copyright (c) 2020, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
}


def test_published_licence_texts(spark):
    texts = [(name, wrap(text)) for name, text in PUBLISHED_TEXTS.items() for wrap in (str, lambda t: t.replace("\n", "\r\n"), lambda t: "x = 1\n" + "\n".join(f"# {line}" for line in t.split("\n")) + "\ny = 2")]
    titles = [("GPL-3.0", "  GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\n Copyright"), ("Apache-2.0", "   Apache License\n  Version 2.0, January 2004\nhttp://www.apache.org/licenses/\n")]
    cut = [("none", "Licensed under the\n\nMIT License."), ("none", "Licensed under. The MIT License."), ("MIT", "Licensed under\nthe MIT License")]
    df = spark.createDataFrame([*texts, *titles, *cut], "name string, text string")
    got = licenses.scan_licenses(df, keep=("name", "text")).collect()
    assert [(r.name, r.license) for r in got if r.name != r.license] == [] and len(got) == 20
    assert {r.sentence_ids for r in got if r.name == "BSD"} == {"AllRights,BSDUse,BSDSourceText,BSDBinaryText"}
    assert all("ApacheLic,ApacheUse,ApacheCopy,ApacheSee" == r.sentence_ids for r in got if r.name == "Apache-2.0" and "compliance" in r.text)
    assert all(any(k in s for k in licenses.KEYWORDS.split("|")) for s in [*licenses.SENTENCES, *licenses.PUBLISHED])


def test_padded_licence_sentences(spark):
    pads = ["*" * 3000, " " * 3000, "# " * 2000]
    texts = [f"/{p} Licensed under the{p}Apache License, Version 2.0 {p}/" for p in pads]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.sentence_ids, r.license) for r in got} == {("ApacheLic", "Apache-2.0")}


MORE_TEXTS = {
    "BSD-3-Clause": PUBLISHED_TEXTS["BSD"].split("THIS SOFTWARE")[0]
    + """3. Neither the name of the University of Somewhere, Anytown, nor the names of
   its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "ISC": """Copyright (c) 2020, The Authors

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.""",
}


def test_more_published_licence_texts(spark):
    comment = lambda mark: lambda t: "x = 1\n" + "\n".join(f"{mark} {line}".rstrip() for line in t.split("\n")) + "\ny = 2"
    texts = [(name, wrap(text)) for name, text in MORE_TEXTS.items() for wrap in (str, comment("#"), comment("//"), comment(" *"), comment("--"), lambda t: "<!--\n" + t + "\n-->")]
    texts += [(licence, f"// SPDX-License-Identifier: {n}\nint main();") for n, licence in licenses.NAMED.items()]
    texts += [("none", "Neither the name of the rose nor the names of its contributors."), ("unknown", "You may obtain a copy of the License at\n\nsomewhere")]
    got = licenses.scan_licenses(spark.createDataFrame(texts, "_ids string, text string"), keep=("_ids", "text")).collect()
    assert [(r[0], r.license, r.sentence_ids) for r in got if r[0] != r.license] == [] and len(got) == len(texts)
