"""Licence scans: a trained paragraph classifier, with template comparison to confirm it.

A paragraph is a line, or each window of PARAGRAPH words (half of them shared with the next) of a longer one. Its features are
the word 1-grams and 2-grams that training has met, counted and divided by the root of its number of words. Multinomial logistic
regression over them gives the probabilities of the licence families, of `unknown` (a licence of no known family) and of `none`.
It is trained on the templates below, each varied in wording, for `unknown` on notices of other licences, and for `none` on a
bounded sample of the corpus's own lines. Two things are calibrated on what training left out: a temperature on variations of the
templates, and the least probability of a family, below which a licence is `unknown`, on those and on notices of licences that
training never saw. A prediction is confirmed if CONFIRM of the word pairs of one of the family's templates stand in the paragraph
in order of the template; `unknown` never is.

Defined results: null and wordless texts have no paragraphs and no hits. Repeated rows get equal results; an empty table gives
an empty result (the sample of `none` is then empty too, and the built-in negatives remain). Columns of the input stay, but for
`licences`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PARAGRAPH = 64
SAMPLE = 3000
CONFIRM = 0.6

# Families of licences and how notices name them.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license", "under the terms of the gnu affero general public license version 3", "agpl 3.0 license"],
    "apache-2.0": ["licensed under the apache license version 2.0", "released under the apache license 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2.0"],
    "bsd": ["licensed under the bsd license", "released under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0": ["released under cc0 1.0", "dedicated to the public domain under the creative commons zero universal dedication"],
    "gpl": ["released under the gnu general public license", "licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license version 2.1"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "proprietary": ["all rights reserved no part may be reproduced without written permission", "copyright all rights reserved"],
}
# Invented and lesser-known licences: the first UNKNOWN_TRAINED teach `unknown`, the others calibrate it.
OTHERS = [
    "licensed under the eclipse public license version 2.0", "released under the zlib license", "this work is licensed under the european union public licence 1.2",
    "distributed under the boost software license version 1.0", "licensed under the harbour loom community license", "released under the terms of the artistic license 2.0",
    "licensed under the open font license 1.1", "released under the isc license", "this work is licensed under the meadow shared source license version 4",
    "distributed under the terms of the python software foundation license", "licensed under the fernworks public license 7", "released under the microsoft reciprocal license",
]
UNKNOWN_TRAINED = 8
NEGATIVES = [
    "the driver lost his license after the accident", "general public access is free of charge", "the terms of the agreement were subject to discussion", "a new version was released under pressure",
    "the fishing license is issued by the county", "students may obtain a copy of the report at the office", "public health and general conditions are met", "the apache people of the south west",
    "mit researchers published a study", "creative work is common in the city", "no part of the road was reserved for bicycles", "the foundation published a free newsletter",
]

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def paragraphs(text: str) -> list[tuple[int, list[str]]]:
    """(number of the line, words) of each paragraph that has words."""
    out = []
    for i, line in enumerate(text.split("\n")):
        ws = words_of(line)
        if ws:
            out.extend((i, ws[j : j + PARAGRAPH]) for j in range(0, max(1, len(ws) - PARAGRAPH // 2), PARAGRAPH // 2))
    return out


@dataclass
class Model:
    families: list[str]
    words: dict[str, int]  # from 1
    pairs: np.ndarray  # sorted codes of known pairs
    weights: np.ndarray  # (1 + words + pairs) x families; row 0 is the bias
    temperature: float = 1.0
    least: float = 0.6  # probability of a family, below which a licence is unknown

    def rows(self, batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, feature, value) of a batch of paragraphs' features."""
        n = np.array([len(ws) for ws in batch], np.int64)
        get = self.words.get
        ids = np.array([get(w, 0) for ws in batch for w in ws], np.int64)
        of = np.repeat(np.arange(len(batch)), n)
        base = len(self.words) + 1
        code = ids[:-1] * base + ids[1:]
        if not len(self.pairs):
            return of[ids > 0], ids[ids > 0], 1 / np.sqrt(n[of[ids > 0]])
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        ok = (self.pairs[at] == code) & (of[:-1] == of[1:])
        para = np.concatenate([of[ids > 0], of[:-1][ok]])
        return para, np.concatenate([ids[ids > 0], base + at[ok]]), 1 / np.sqrt(n[para])

    def logits(self, batch: list[list[str]]) -> np.ndarray:
        out = np.tile(self.weights[0], (len(batch), 1))
        para, feature, value = self.rows(batch)
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(para, value * self.weights[feature, j], len(batch))
        return out / self.temperature


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def variations(rng: np.random.Generator, template: str, filler: list[str], n: int) -> list[list[str]]:
    """The template's words with words of other text around them, and now and then one word lost."""
    base, out = words_of(template), []
    for _ in range(n):
        ws = [w for w in base if rng.random() > 0.03] or base
        before, after = rng.integers(0, 5, 2) if rng.random() < 0.6 else (0, 0)
        out.append([*rng.choice(filler, before).tolist(), *ws, *rng.choice(filler, after).tolist()] if filler else ws)
    return out


def train(lines: list[str], seed: int = 11, each: int = 40, steps: int = 250) -> Model:
    """Fit the classifier; lines are the corpus's sample of `none`."""
    rng = np.random.default_rng(seed)
    plain = [words_of(x)[:PARAGRAPH] for x in lines]
    plain = [ws for ws in plain if ws and template_match(ws, None)[1] < 0.5]
    filler = sorted({w for ws in plain for w in ws})[:2000]
    families = [*TEMPLATES, "unknown", "none"]
    data = [(k, ws) for k, family in enumerate(TEMPLATES) for t in TEMPLATES[family] for ws in variations(rng, t, filler, each)]
    unknown, none = len(TEMPLATES), len(TEMPLATES) + 1
    data += [(unknown, ws) for t in OTHERS[:UNKNOWN_TRAINED] for ws in variations(rng, t, filler, each)]
    data += [(none, ws) for t in NEGATIVES for ws in variations(rng, t, filler, each)] + [(none, ws) for ws in plain]
    told = [*sum(TEMPLATES.values(), []), *OTHERS[:UNKNOWN_TRAINED], *NEGATIVES]
    known = sorted({w for t in told for w in words_of(t)})
    words = {w: i + 1 for i, w in enumerate(known)}
    pairs = np.array(sorted({words[a] * (len(words) + 1) + words[b] for t in told for a, b in zip(words_of(t), words_of(t)[1:])}), np.int64)
    model = Model(families, words, pairs, np.zeros((1 + len(words) + len(pairs), len(families))))
    order = rng.permutation(len(data))
    held = order[: len(order) // 5]
    order = order[len(order) // 5 :]
    y = np.array([k for k, _ in data])
    para, feature, value = model.rows([ws for _, ws in data])
    x = np.zeros((len(data), len(model.weights)))
    np.add.at(x, (para, feature), value)
    x[:, 0] = 1
    target = np.eye(len(families))[y]
    share = 1 / np.bincount(y, minlength=len(families)).clip(1)
    w = share[y[order]][:, None]
    w /= w.sum()
    v = np.zeros_like(model.weights)
    for _ in range(steps):  # gradient descent with momentum; classes weigh the same
        g = x[order].T @ (w * (_softmax(x[order] @ model.weights) - target[order])) + 1e-6 * model.weights
        v = 0.9 * v - 20.0 * g
        model.weights += v
    scores, grid = x[held] @ model.weights, np.geomspace(0.25, 4, 25)
    losses = [-np.log(_softmax(scores / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    strange = _softmax(model.logits([ws for t in OTHERS[UNKNOWN_TRAINED:] for ws in variations(rng, t, filler, each)]))[:, :unknown].max(1)
    sure = _softmax(scores / model.temperature)[y[held] < unknown, :unknown].max(1)
    cuts = np.arange(0.3, 0.96, 0.01)
    right = [(strange < c).mean() + (sure >= c).mean() for c in cuts]  # either error weighs the same
    model.least = float(cuts[int(np.argmax(right))])
    return model


_PAIRS = {k: [list(zip(ws, ws[1:])) for ws in map(words_of, v)] for k, v in TEMPLATES.items()}


def template_match(ws: list[str], family: str | None) -> tuple[str, float]:
    """The family (this one, or the best of all) and the largest share of one of its templates' word pairs that ws has."""
    have = set(zip(ws, ws[1:]))
    scored = [(sum(p in have for p in pairs) / len(pairs), k) for k in ([family] if family else _PAIRS) for pairs in _PAIRS[k]]
    best = max(scored, key=lambda x: x[0])
    return best[1], best[0]


_HIT = "array<struct<line:int,family:string,score:double,similarity:double,confirmed:boolean>>"


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with n_paragraphs and licences: the paragraphs that are not `none`."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = docs.drop("n_paragraphs", "licences")
    at = kept.columns.index(text_col)
    hit = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        m = sent.value
        none = m.families.index("none")
        for b in batches:
            hits, n = [], []
            where, batch = [], []
            for i, text in enumerate(b.column(at).to_pylist()):
                got = paragraphs(text or "")
                n.append(len(got))
                hits.append([])
                where.extend((i, line) for line, _ in got)
                batch.extend(ws for _, ws in got)
            if batch:
                p = _softmax(m.logits(batch))
                for k in np.flatnonzero(p.argmax(1) != none):
                    i, line = where[k]
                    best = int(p[k].argmax())
                    family, score = m.families[best], float(p[k, best])
                    likeness = template_match(batch[k], family)[1] if family in TEMPLATES else 0.0
                    hits[i].append({"line": line, "family": family if score >= m.least else "unknown", "score": score, "similarity": likeness, "confirmed": score >= m.least and likeness >= CONFIRM})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(hits, hit)], [*b.schema.names, "n_paragraphs", "licences"])

    schema = T.StructType([*kept.schema.fields, T.StructField("n_paragraphs", T.LongType())]).add("licences", T._parse_datatype_string(_HIT))
    return kept.mapInArrow(run, schema)


def sample_lines(docs: DataFrame, n: int = SAMPLE, text_col: str = "text") -> list[str]:
    """The corpus's own lines for `none`: at most n distinct whole lines from any place of any text, those with the smallest hashes.
    A share of all hashes is taken first, so that what a task sends on is bounded by n and not by its lines."""
    lines = F.split(F.col(text_col), "\n")
    total = docs.agg(F.sum(F.size(lines).cast("long"))).collect()[0][0] or 0
    bound = int(-(2**63) + min(1.0, 4 * n / max(total, 1)) * (2**64 - 2**11))
    some = F.filter(F.array_distinct(lines), lambda x: (F.xxhash64(x) <= bound) & (F.trim(x) != ""))
    rows = docs.select(F.explode(some).alias("line")).distinct().orderBy(F.xxhash64("line"), "line").limit(n).collect()  # n lines at most
    return [r["line"] for r in rows]


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with the licence families it names."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(sample_lines(docs)))
    sure = F.filter("licences", lambda x: x["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_suspects"), F.size(sure).cast("long").alias("n_confirmed"), families.alias("families"), F.coalesce(F.array_max(F.transform(sure, lambda x: x["score"])), F.lit(0.0)).alias("score"))


QUERIES = {"op9_licenses": op9_licenses}
SQL: dict[str, str] = {}
