"""License scans. Native: DataFrame operations only.

Parts of a file are compared with license templates by the cosine of sparse TF-IDF vectors: its header and other blocks (lines up to one without a letter or digit,
as licence texts and comment blocks have them), its lines, the sentences of its blocks, so that a notice is found inside a longer or over several lines, and a licence file as a
whole. Templates are the licences' titles, their standard headers, the paragraphs that grant, whole short licences, and one-line notices. A file's own license is that of the
best part of at least `threshold`. A licence file (its name says so) speaks for its directory, and files without a license of
their own inherit from the nearest ancestor directory that has one, found by joining directories with their ancestors' paths.

idf(w) = 1 + ln((1 + T) / (1 + templates with w)) over the T templates; words are runs of a-z and 0-9 after lower-casing. A part without any of
the key words that licences use, or with one distinct word alone, is no notice and isn't compared. Ties go to the first id. Null texts are empty,
null paths have no directory and inherit nothing. Repeated rows are each returned. Of several licence files in one directory
the best score counts, then the first id. An empty table gives an empty table; columns beyond path, text and those kept aren't read.
Licences whose parts are the same in all templates (BSD with two and with three clauses) aren't told apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Titles, headers, grants and notices by license; fixed values, from the public texts. Case and signs don't matter.
TEMPLATES = {
    "Apache-2.0": [
        "licensed under the apache license version 2 0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["licensed under cc by 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "released under the mit license",
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "subject to the terms of the mozilla public license v 2 0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain",
    ],
}
THRESHOLD = 0.8
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"


#: Each template has one of these; "mit" is no key word, since it is a common word elsewhere.
KEY_WORDS = ("apache", "commons", "copyleft", "endorse", "gnu", "licence", "license", "licensed", "licenses", "mozilla", "permission", "redistribution", "sublicense", "unencumbered", "warranties")
#: What ends a block, and a sentence in it.
BLOCK_END, SENTENCE_END = r"\n[^a-z0-9\n]*\n", r"[.;:!?][ \t\n]+"


def template_weights(templates: dict[str, list[str]]) -> tuple[dict[str, float], dict[str, dict[str, float]], float]:
    """idf by word, unit vectors by template (license, a blank, number), and the idf of a word that no template has."""
    words = {f"{k} {i}": re.findall("[a-z0-9]+", t.lower()) for k, ts in templates.items() for i, t in enumerate(ts)}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: 1 + math.log((1 + len(words)) / (1 + n)) for w, n in df.items()}
    out = {}
    for k, ws in words.items():
        v = {w: n * idf[w] for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[k] = {w: x / norm for w, x in v.items()}
    return idf, out, 1 + math.log(1 + len(words))


_BEST = "struct<score:double,id:string>"


def better(a: Column, s: Column) -> Column:
    """The higher score; of equal ones the first id."""
    return F.when(a.isNull() | (s["score"] > a["score"]) | ((s["score"] == a["score"]) & (s["id"] < a["id"])), s).otherwise(a)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


_MARKS = rf"(^|[^a-z0-9])({'|'.join(KEY_WORDS)})($|[^a-z0-9])"


def parts_of(text: Column, whole: Column) -> Column:
    """The lower-case text's blocks, lines, blocks' sentences and, where so said, itself; each once, if it has a key word."""
    has = lambda x: x.rlike(_MARKS)
    blocks = F.filter(F.split(text, BLOCK_END, -1), has)
    sentences = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, SENTENCE_END, -1))), has)
    lines = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n", -1))), has)
    return F.array_distinct(F.concat(blocks, lines, sentences, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def own_license(text: Column, whole: Column, templates: dict[str, list[str]], threshold: float) -> Column:
    """struct(score, id) of the best part, or null. whole: whether the text as a whole is a part, too."""
    idf, vectors, unseen = template_weights(templates)
    low = F.lower(F.coalesce(text, F.lit("")))
    lines = F.when(low.rlike(_MARKS), _let(low, lambda x: parts_of(x, whole)))
    idf_of = F.create_map(*(x for w, v in idf.items() for x in (F.lit(w), F.lit(v))))
    vector_of = {name: F.create_map(*(x for w, y in v.items() for x in (F.lit(w), F.lit(y)))) for name, v in sorted(vectors.items())}

    def dot(tf: Column, name: str) -> Column:
        return F.aggregate(tf, F.lit(0.0), lambda a, t: a + t["x"] * F.coalesce(F.try_element_at(vector_of[name], t["w"]), F.lit(0.0)))

    def weighted(ws: Column, firsts: Column) -> Column:
        """Distinct words with tf x idf, from sorted words and the places where a new one begins."""
        ends = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(ws))
        return F.transform(firsts, lambda p, k: F.struct(F.get(ws, p).alias("w"), ((ends(k) - p) * F.coalesce(F.try_element_at(idf_of, F.get(ws, p)), F.lit(unseen))).alias("x")))

    def best(tf: Column) -> Column:
        norm = F.sqrt(F.aggregate(tf, F.lit(0.0), lambda a, t: a + t["x"] * t["x"]))
        return _let(norm, lambda n: F.aggregate(F.array(*(F.struct(F.round(dot(tf, name) / n, 6).alias("score"), F.lit(name.split()[0]).alias("id")) for name in vector_of)), F.lit(None).cast(_BEST), better))

    def score(line: Column) -> Column:
        words = F.array_sort(F.regexp_extract_all(line, F.lit("([a-z0-9]+)"), F.lit(1)))
        firsts = lambda ws: F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        return _let(words, lambda ws: _let(firsts(ws), lambda f: F.when(F.size(f) > 1, _let(weighted(ws, f), best))))

    hits = F.filter(F.transform(lines, score), lambda s: s["score"] >= threshold)
    return F.aggregate(hits, F.lit(None).cast(_BEST), better)


def scan(files: DataFrame, keep: list[str], templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files: path, text and keep columns. Returns keep, path, own_license, own_score, inherited_from, license."""
    speaks = F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_NAME), F.lit(False))
    own = own_license(F.col("text"), speaks, templates, threshold)
    dir_of = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    found = files.select(*keep, "path", own.alias("own")).select(*keep, "path", F.col("own.id").alias("own_license"), F.col("own.score").alias("own_score"), dir_of.alias("dir"))
    found = materialize(found, "own-licenses")  # texts are read once; three tables come from this one
    told = (
        found.where(F.col("own_license").isNotNull() & speaks)
        .groupBy(F.col("dir").alias("at"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("id"))).alias("m"))
        .select("at", F.col("m.id").alias("dir_license"))
    )
    parts = F.split("dir", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))
    # the root's path is empty, as is that of a path without a slash
    ups = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))).otherwise(above)
    dirs = found.where(F.col("dir").isNotNull() & F.col("own_license").isNull()).select("dir").distinct().select("dir", F.explode(ups).alias("a")).select("dir", "a.depth", "a.up")
    nearest = dirs.join(told, F.col("up") == F.col("at")).groupBy(F.col("dir").alias("__dir")).agg(F.max(F.struct("depth", "at", "dir_license")).alias("n"))
    out = found.join(nearest, F.col("dir") == F.col("__dir"), "left")
    inherits = F.col("own_license").isNull()
    return out.select(
        *keep,
        "path",
        "own_license",
        "own_score",
        F.when(inherits, F.col("n.at")).alias("inherited_from"),
        F.coalesce("own_license", "n.dir_license").alias("license"),
    )


def corpus_files(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source / thousand / fifty / doc_id.txt. The first file of each directory of fifty is its LICENSE."""
    d = F.col("doc_id")
    name = F.when(F.pmod(d, F.lit(50)) == 0, F.lit("LICENSE")).otherwise(F.concat(d.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(d / 1000).cast("string"), F.floor(d / 50).cast("string"), name).alias("path"))


def oracle(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan(corpus_files(documents), ["doc_id"])."""
    idf, vectors, unseen = template_weights(templates)
    q = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({q(k)}, {q(k.split()[0])}, {q(w)}, {x!r}::DOUBLE)" for k, v in sorted(vectors.items()) for w, x in v.items())
    re_ = lambda r: "'" + r.replace("'", "''") + "'"
    idfs = ", ".join(f"({q(w)}, {x!r}::DOUBLE)" for w, x in idf.items())
    return f"""
    WITH tw(name, id, w, x) AS (VALUES {weights}), iw(w, idf) AS (VALUES {idfs}),
    files AS (SELECT doc_id, text, coalesce(source, 'none') || '/' || floor(doc_id / 1000)::BIGINT || '/' || floor(doc_id / 50)::BIGINT || '/'
                     || CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path FROM documents),
    whole AS (SELECT doc_id, path, lower(coalesce(text, '')) AS l FROM files),
    blocks AS (SELECT doc_id, unnest(string_split_regex(l, {re_(BLOCK_END)})) AS l FROM whole),
    parts AS (SELECT doc_id, l FROM blocks UNION ALL SELECT doc_id, unnest(string_split(l, chr(10))) FROM blocks UNION ALL SELECT doc_id, unnest(string_split_regex(l, {re_(SENTENCE_END)})) FROM blocks
              UNION ALL SELECT doc_id, l FROM whole WHERE path LIKE '%/LICENSE'),
    lines AS (SELECT doc_id, row_number() OVER () AS line, l FROM (SELECT DISTINCT doc_id, l FROM parts WHERE regexp_matches(l, {re_(_MARKS)}))),
    words AS (SELECT doc_id, line, unnest(regexp_extract_all(l, '[a-z0-9]+')) AS w FROM lines),
    tf AS (SELECT doc_id, line, words.w, count(*) * coalesce(any_value(idf), {unseen!r}::DOUBLE) AS x FROM words LEFT JOIN iw ON words.w = iw.w GROUP BY ALL),
    norm AS (SELECT line, sqrt(sum(x * x)) AS n FROM tf GROUP BY line HAVING count(*) > 1),
    dots AS (SELECT doc_id, line, name, id, sum(tf.x * tw.x) AS d FROM tf JOIN tw ON tf.w = tw.w GROUP BY ALL),
    hit AS (SELECT doc_id, id, round(d / n, 6) AS score FROM dots JOIN norm USING (line) WHERE round(d / n, 6) >= {threshold}),
    own AS (SELECT doc_id, first(id ORDER BY score DESC, id) AS own_license, max(score) AS own_score FROM hit GROUP BY doc_id),
    found AS (SELECT doc_id, path, own_license, own_score, regexp_replace(path, '/[^/]*$', '') AS dir FROM files LEFT JOIN own USING (doc_id)),
    told AS (SELECT dir AS ldir, first(own_license ORDER BY own_score DESC, own_license) AS dir_license FROM found WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY dir),
    near AS (SELECT d.dir, first(ldir ORDER BY length(ldir) DESC) AS ldir, first(dir_license ORDER BY length(ldir) DESC) AS dir_license
             FROM (SELECT DISTINCT dir FROM found) d JOIN told ON ldir = '' OR d.dir = ldir OR starts_with(d.dir, ldir || '/') GROUP BY d.dir)
    SELECT doc_id, path, own_license, own_score, CASE WHEN own_license IS NULL THEN ldir END AS inherited_from, coalesce(own_license, dir_license) AS license
    FROM found LEFT JOIN near USING (dir)"""
