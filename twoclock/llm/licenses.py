"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories.

DataFrame functions only.
"""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from .common import OWN

# License notices, fixed values: (SPDX identifier, notice).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and distribute this software under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

_WORDS = "[^a-z0-9]+"
#: A passage ends at a line end, or after a full stop with a space.
_ENDS = r"\n|(?<=[.!?])\s+"


def _terms(text):
    return [w for w in re.split(_WORDS, text.lower()) if w]


def _words(column):
    return F.filter(F.split(F.lower(column), _WORDS), lambda w: w != "")


def document_frequencies(files, text="text", templates=TEMPLATES):
    """(rows, {term: rows that hold it}) for the terms of the templates, over all rows."""
    terms = sorted({t for _, notice in templates for t in _terms(notice)})
    held = F.array_intersect(_words(F.coalesce(F.col(text), F.lit(""))),
                             F.array(*[F.lit(t) for t in terms]))
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("term"))
    counts = {r["term"]: r["n"] for r in
              rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), {t: counts.get(t, 0) for t in terms}


class Weights:
    """Inverse document frequencies, and the unit vectors of the templates."""

    def __init__(self, rows, frequencies, templates=TEMPLATES):
        self.unseen = math.log(rows + 1) + 1
        self.idf = {t: math.log((rows + 1) / (n + 1)) + 1 for t, n in frequencies.items()}
        self.names, self.vectors = [], []
        for name, notice in templates:
            vector = {t: n * self.idf[t] for t, n in Counter(_terms(notice)).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.names.append(name)
            self.vectors.append({t: v / norm for t, v in vector.items()})

    def telling(self, least):
        """Terms of which a text must hold one to reach cosine `least` with a template:
        by Cauchy and Schwarz, the other terms of a template reach less than that."""
        found = set()
        for vector in self.vectors:
            left = 1.0
            for term, value in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if left < least * least * (1 - 1e-9):
                    break
                found.add(term)
                left -= value * value
        return sorted(found)


def notices(files, weights, path="path", text="text", least=0.8):
    """(key, license, score) of the rows of `files` with a passage, or as a whole, that
    has cosine `least` or more to a template: the best such, ties by name. The key is the
    path and a hash of the text.

    Only passages with a telling term are cut to words, so most text is passed over by
    one pattern search.
    """
    telling = rf"(?<![a-z0-9])({'|'.join(weights.telling(least))})(?![a-z0-9])"
    lowered = F.lower(F.col(text))
    rows = files.where(lowered.rlike(telling)).select(
        F.struct(F.col(path).alias("path"), F.xxhash64(text).alias("hash")).alias("key"),
        F.lower(F.col(text)).alias("whole")).distinct()
    units = (rows.select("key", F.posexplode(F.array_prepend(F.split("whole", _ENDS),
                                                             F.col("whole"))))
             .where(F.col("col").rlike(telling)))
    words = (units.select("key", "pos", F.explode(_words(F.col("col"))).alias("term"))
             .groupBy("key", "pos", "term").agg(F.count(F.lit(1)).alias("tf")))
    idf = F.create_map(*[F.lit(x) for t, v in weights.idf.items() for x in (t, v)])
    vectors = F.create_map(*[x for t in weights.idf for x in (F.lit(t), F.array(
        *[F.lit(float(v.get(t, 0.0))) for v in weights.vectors]))])
    value = F.col("tf") * F.coalesce(F.element_at(idf, F.col("term")), F.lit(weights.unseen))
    shares = F.element_at(vectors, F.col("term"))
    sums = (words.select("key", "pos", value.alias("v"), shares.alias("w"))
            .groupBy("key", "pos").agg(
                F.sum(F.col("v") * F.col("v")).alias("square"),
                *[F.sum(F.coalesce(F.col("w")[k] * F.col("v"), F.lit(0.0))).alias(f"dot{k}")
                  for k in range(len(weights.names))]))
    best = F.array_max(F.array(*[F.struct(
        F.round(F.col(f"dot{k}") / F.sqrt("square"), 9).alias("score"),
        F.lit(-k).alias("rank"), F.lit(name).alias("license"))
        for k, name in enumerate(weights.names)]))
    return (sums.select("key", best.alias("best")).where(F.col("best.score") >= least)
            .groupBy("key").agg(F.max("best").alias("best"))
            .select("key", "best.license", "best.score"))


def folder_of(path):
    """The directory of a path; "" for none."""
    return F.coalesce(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def ancestors_of(folder):
    """A directory and those above it, up to "", with their depths: an array of structs."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at")))) \
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
            n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at"))))


#: File names that speak for their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([-._][^/]*)?$"


def scan(files, path="path", text="text", least=0.8, templates=TEMPLATES, carry=()):
    """For each row of `files`: path, the columns of `carry`, license, score, origin and
    from_path.

    A license of a row's own (origin `own`) is that of its best passage or of its whole
    text. A row without one inherits (origin `inherited`) from the nearest directory at
    or above its own in which a licence file has one: the best by score, then name, then
    path; from_path names that file. Else origin is `none` and license is NULL.

    Null, empty and wordless texts have no license of their own. A null path is in the
    topmost directory and is no licence file. Rows alike in path and text are one file.
    Frequencies count every row. Only directories, not files, are joined to their
    ancestors, and files meet the directories that have a license by an equi-join.
    """
    weights = Weights(*document_frequencies(files, text, templates), templates)
    own = notices(files, weights, path, text, least)
    found = own.where(F.col("key.path").rlike(LICENSE_FILE)).select(
        folder_of(F.col("key.path")).alias("at"), "license", "score",
        F.col("key.path").alias("from_path"))
    spoken = found.groupBy("at").agg(F.min(F.struct(
        (-F.col("score")).alias("down"), "license", "from_path")).alias("best"))
    rows = files.select(F.struct(F.col(path).alias("path"), F.xxhash64(text).alias("hash"))
                        .alias(OWN + "key"), folder_of(F.col(path)).alias(OWN + "folder"),
                        path, *[c for c in carry if c != path])
    folders = rows.select(F.col(OWN + "folder").alias("folder")).distinct()
    above = (folders.select("folder", F.explode(ancestors_of(F.col("folder"))).alias("up"))
             .select("folder", "up.depth", "up.at").join(spoken, "at")
             .groupBy("folder").agg(F.max_by("best", "depth").alias("best")))
    joined = (rows.join(own.select(F.col("key").alias(OWN + "key"),
                                   F.col("license").alias(OWN + "license"),
                                   F.col("score").alias(OWN + "score")), OWN + "key", "left")
              .join(above.select(F.col("folder").alias(OWN + "folder"),
                                 F.col("best").alias(OWN + "best")), OWN + "folder", "left"))
    mine, theirs = F.col(OWN + "license"), F.col(OWN + "best")
    return joined.select(
        path, *[c for c in carry if c != path],
        F.coalesce(mine, theirs["license"]).alias("license"),
        F.when(mine.isNotNull(), F.col(OWN + "score")).otherwise(-theirs["down"]).alias("score"),
        F.when(mine.isNotNull(), "own").when(theirs.isNotNull(), "inherited").otherwise("none")
        .alias("origin"),
        F.when(mine.isNull(), theirs["from_path"]).alias("from_path"))
