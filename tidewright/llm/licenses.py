"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, table

# Short forms of public licences, as headers and licence files state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice in the documentation. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
)

#: Names that stand beside other licences, so they only count where nothing else is found.
WEAK = ("Proprietary",)
#: A text that names a licence is compared with the templates; its best cosine has to reach this.
MIN_COSINE = 0.6
#: Words up to which a whole text is compared, as a licence file or a header in itself.
SHORT_FILE = 400
_CUE = "(?i)licen[cs]|copyright|rights reserved|free software|permission is hereby|redistribution and use|creative commons|source code form"
_SPLIT = "[^a-z0-9.]+"
#: What parts header blocks: a line without a letter or digit, comment signs or not.
_GAP = "\\n[^\\p{L}\\p{N}\\n]*(?=\\n)"


def _terms(text: Column) -> Column:
    """Lower-case letters, digits and dots within numbers as terms."""
    bare = F.regexp_replace(F.lower(text), "\\.(?![0-9])", " ")
    return F.filter(F.split(bare, _SPLIT), lambda w: w != "")


def _units(body: Column) -> Column:
    """array<struct<rank,unit>> of what names a licence in a text: the whole of a short file (2),
    its blocks of lines between empty ones (1), and single lines (0)."""
    named = lambda x: x.rlike(_CUE)

    def of(t: Column) -> Column:
        as_unit = lambda rank: lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("unit"))
        whole = F.filter(F.array(t), lambda x: F.size(F.split(x, "\\s+")) <= SHORT_FILE)
        blocks = let(F.split(t, _GAP, -1), lambda b: F.when(F.size(b) > 1, F.filter(b, named)).otherwise(F.slice(b, 1, F.when(F.size(whole) > 0, 0).otherwise(1))))
        lines = F.filter(F.split(t, "\n", -1), named)
        return F.concat(F.transform(whole, as_unit(2)), F.transform(blocks, as_unit(1)), F.transform(lines, as_unit(0)))

    none = F.array().cast("array<struct<rank:int,unit:string>>")
    return let(body, lambda t: F.when(t.rlike(_CUE), of(t)).otherwise(none))


def scan(docs: DataFrame, key: list[str], text: str = "text", templates=TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """`key`, license, cosine: the best template of each row that has one.

    What names a licence is compared as a whole: short files, header blocks (lines between empty
    ones, comment signs or not) and single lines. Units and templates are sparse TF-IDF vectors
    over the templates' terms and one dimension for each other word; inverse document frequencies
    come from all rows of the input and from the templates, so a small table has usable ones too.
    The widest unit that reaches `min_cosine` decides, then the cosine, then the first template;
    names in `WEAK` only count where no other is found. Null and empty texts have no units; texts
    are read in whole; an empty table gives no rows. `key` has to tell rows apart; rows alike in
    it count as one.
    """
    spark = docs.sparkSession
    # The templates are a fixed table, so their terms are counted here, as Spark's expressions would.
    split = lambda t: [w for w in re.split(_SPLIT, re.sub(r"\.(?![0-9])", " ", t.lower())) if w]
    bags = [(i, name, Counter(split(t))) for i, (name, t) in enumerate(templates)]
    vocabulary = sorted({w for *_, bag in bags for w in bag})
    words = F.array(*map(F.lit, vocabulary))
    body = F.coalesce(F.col(text), F.lit(""))
    held = F.array_intersect(F.array_distinct(F.split(F.lower(body), _SPLIT)), words)
    n, *df = docs.select(held.alias("held")).agg(F.count("*"), *[F.count_if(F.array_contains("held", w)) for w in vocabulary]).first()
    n += len(bags)
    idf = {w: math.log((n + 1.0) / (c + sum(w in bag for *_, bag in bags) + 1.0)) + 1.0 for w, c in zip(vocabulary, df)}
    other = float(math.log(n + 1.0) + 1.0)
    weigh = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])
    rows = []
    for tid, name, bag in bags:
        norm = math.sqrt(sum((tf * idf[w]) ** 2 for w, tf in bag.items()))
        rows += [F.struct(F.lit(tid).alias("tid"), F.lit(name).alias("license"), F.lit(w).alias("term"), F.lit(tf * idf[w] / norm).alias("tw")) for w, tf in bag.items()]
    known = spark.range(1).select(F.inline(F.array(*rows)))
    # Distinct units are few against rows, as headers repeat: each is compared once, under a digest.
    # A unit's terms stay where the unit is, so no text and no term is shuffled with it again.
    named = materialize(docs.select(*key, F.inline(_units(body))).withColumn("u", F.md5(F.col("unit").cast("binary"))), "license-units")
    unit = named.groupBy("u").agg(F.first("unit").alias("unit"))
    vector = unit.select("u", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("u", "term").agg(F.count("*").alias("tf"))
    vector = vector.withColumn("w", F.col("tf") * F.coalesce(F.try_element_at(weigh, F.col("term")), F.lit(other)))
    vector = materialize(vector.select("u", "term", "w"), "license-vectors")
    length = vector.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    close = vector.join(F.broadcast(known), "term").groupBy("u", "tid", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    best = close.join(length, "u").withColumn("cosine", cosine).where(F.col("cosine") >= min_cosine)
    place = F.struct((~F.col("license").isin(*WEAK)).alias("strong"), "cosine", (-F.col("tid")).alias("t"), "license")
    best = best.groupBy("u").agg(F.max(place).alias("b")).select("u", "b.*")
    out = named.select(*key, "rank", "u").distinct().join(best, "u").groupBy(*key).agg(F.max(F.struct("strong", "rank", "cosine", "t", "license")).alias("b"))
    return out.select(*key, "b.license", "b.cosine")


def inherit(files: DataFrame, path: str = "path", own: str = "license", declares: str = "declares") -> DataFrame:
    """Add `effective`, `origin`, `distance` and `conflict`: a file's own licence, or that of the
    nearest ancestor directory of which a licence file (`declares`) states one.

    A file's ancestors are few, so each file with none of its own is joined once for each with
    the directories' table, which has one row a directory. Where the licence files of a directory
    state several licences, `conflict` is true and `effective` is all their names, sorted and
    joined by " OR ", as none of them is known to hold. Null paths inherit nothing; repeated rows
    inherit alike; an empty table gives no rows.
    """
    parent = lambda p: F.when(F.contains(p, F.lit("/")), F.regexp_extract(p, "^(.*)/[^/]*$", 1)).otherwise("")
    dirs = files.where(F.col(declares) & F.col(own).isNotNull()).groupBy(parent(F.col(path)).alias("_dir")).agg(F.sort_array(F.collect_set(own)).alias("_lics"))  # few names each
    parts = F.split(parent(F.col(path)), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("_dir")))
    wanting = files.where(F.col(own).isNull() & F.col(path).isNotNull()).select(F.col(path).alias("_path")).distinct()
    up = wanting.withColumn(path, F.col("_path")).select("_path", F.size(parts).alias("_n"), F.inline(above)).where((F.col("_dir") != "") | (F.col("depth") == 0))
    nearest = up.join(dirs, "_dir").groupBy("_path").agg(F.max(F.struct("depth", "_dir", "_lics", "_n")).alias("b"))
    nearest = nearest.select("_path", "b.*", F.array_join("b._lics", " OR ").alias("_lic"))
    out = files.join(nearest, files[path] == nearest["_path"], "left")
    kept = [files[c] for c in files.columns]
    return out.select(
        *kept,
        F.coalesce(F.col(own), F.col("_lic")).alias("effective"),
        F.when(F.col(own).isNotNull(), F.lit("own")).when(F.col("_lic").isNotNull(), F.col("_dir")).alias("origin"),
        F.when(F.col(own).isNotNull(), F.lit(0)).otherwise(F.col("_n") - F.col("depth") + 1).cast("int").alias("distance"),
        (F.col(own).isNull() & (F.coalesce(F.size("_lics"), F.lit(0)) > 1)).alias("conflict"),
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents, taken as files source/lang/doc_id; a document of fewer than 60
    words that states a licence is taken for its directory's licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    few = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\x0b\f\r]+"), lambda w: w != "")) < 60
    slim = docs.select("doc_id", path.alias("path"), few.alias("declares"), F.col("text"))
    found = scan(slim, ["doc_id", "path"])
    files = slim.select("doc_id", "path", "declares").join(found.withColumnsRenamed({"doc_id": "_d", "path": "_p"}), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    out = inherit(files.select("doc_id", "path", "declares", "license", "cosine"))
    return out.select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "effective", "origin", "distance", "conflict")
