"""Licence scans by a trained paragraph classifier, with DataFrame functions and Spark's own learning library only.

A text is taken apart into sentences: wrapped lines are joined, blank lines, new lines that begin with a capital and ends of
sentences part them, so a notice is found in a line of its own as in the middle of prose. Sentences without a mark, a
word of which every licence sentence has at least one, are no licence. Of the others the words and pairs of neighbours
that licence texts have are counted, and a multinomial logistic regression gives the probability of each family, of
UNKNOWN (sentences that several families share, or licences of no known family) and of NONE. It is fitted on the sentences
of the templates and pieces of them, on sentences that speak of licences and grant none, and on a bounded sample of the
corpus's own. The threshold is calibrated by folds of whole templates, so that no sentence is judged by a fit that saw it.

A guess is confirmed by the templates: the words and pairs that tell families apart, weighed by how few families have them,
must agree with a template of the guessed family and with those of no other as well. Else the sentence is unknown.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.shared import materialize

#: Sentences of the corpus, spread by a hash, that stand for "no licence" in the fit; folds of the calibration.
MAX_PLAIN, FOLDS = 3000, 3
#: Agreement with a template that confirms a guess, and by how much it must exceed that with any other family.
SIMILAR, MARGIN = 0.5, 0.05
#: Least and greatest threshold of a probability.
LEAST, MOST = 0.3, 0.95
NONE, UNKNOWN = "none", "unknown"
#: What parts words, and what parts sentences.
GAP = r"[^a-z0-9+]+"
SENTENCE = r"\r?\n[ \t]*(?:\r?\n)+|\r?\n(?![ \t]*[a-z])|(?<=[.!?;][\"')\]]{0,2})\s+(?=[\"'(\[]?[A-Z0-9*])"
#: Every licence sentence has one of these.
SURE_MARKS = r"licen[cs]|copyright|copyleft|permission|redistribut|warrant|unencumbered|public domain|free of charge|spdx|creative commons|cc[ -]by|cc0|gpl|as is|as-is|merchantab|misrepresent"
MARKS = SURE_MARKS + r"|permit|liab|attribution|patent|trademark|endorse|waive"
#: A sentence that grants has one of these; one that has any of those names a licence to set it aside.
GRANTS = r"licen[cs]ed|releas|distribut|available|permi(?:t|ssion)|publish|dedicat|subject to|terms|govern|cover|\bunder\b|spdx|as[- ]is|warrant|waive|redistribut|\bfree\b|unencumbered|copy of|copies|visit|refer|\buses?\b|\bsee\b|\bmay\b|do what|conditions|shared|liab|includes"
DENIES = r"(?:\b(?:not|never|no longer|nor)|n['\u2019]t)\s+(?:[a-z]+\s+){0,2}(?:licen[cs]ed|released|distributed|available|covered|governed|published|offered)\s+(?:[a-z]+\s+)?(?:under|by|as)\b|\b(?:unlike|instead of|rather than|as opposed to|in contrast to|incompatible with|not compatible with)\b"
#: Several licences in one sentence: what says so, what stands between their names, what stands before them.
SEVERAL = r"(?i)\b(?:dual|dually|tri|double|multi)[- ]?licen[cs]ed|\b(?:either|both)\b|your (?:choice|option)|\blicen[cs]es\b|spdx-license-identifier:.*\s(?:or|and)\s"
BETWEEN = r"(?i),?\s+(?:or|and|as well as)\s+|\s*[/;]\s*"
BEFORE = r"(?i)^.*\b(?:licen[cs]ed|released|distributed|available|offered|provided)\b|^\s*(?:(?:both|either|under|of|the|a|an|terms|your|choice|option|at|by)\b\s*)+|\blicen[cs]es\b|[()]|[.]\s*$"

# Wording of public licence notices by family, a tuple for each template.
TEMPLATES = [
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "This software is released under the Apache License 2.0, see the Apache Software Foundation for its text. Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license. Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("bsd", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd", "Released under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Licensed under the 2-clause BSD license. This file is distributed under the new BSD License."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.'),
    ("isc", "Released under the ISC License. Distributed under the terms of the ISC license."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution, it is part of the license."),
    ("zlib", "Licensed under the zlib/libpng license. Released under the zlib License."),
    ("boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    ("boost", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following.'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "Licensed under the GPL version 2 or later. Released under the GNU GPL v3. Distributed under the terms of the GNU GPLv2."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("lgpl", "Licensed under the LGPL, version 2.1. This work is licensed under the GNU Lesser General Public License, version 3. Licensed under the GNU LGPL v3."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program."),
    ("agpl", "Licensed under the AGPL, version 3. This work is licensed under the GNU Affero General Public License, version 3. Released under the GNU AGPL v3."),
    ("gfdl", 'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".'),
    ("gfdl", "This work is licensed under the GNU Free Documentation License, version 1.3. Licensed under the GFDL."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0. Released under the MPL 2.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution. Licensed under the Eclipse Public License, version 2.0."),
    ("eupl", 'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"). Licensed under the European Union Public Licence, version 1.2.'),
    ("cddl", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). Licensed under the Common Development and Distribution License, version 1.0. Released under the CDDL 1.0.'),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("unlicense", "Released under the Unlicense. For more information on this license, please refer to https://unlicense.org"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."),
    ("cc0", "This work is published under CC0 1.0 Universal, public domain dedication. Licensed under CC0 1.0. Dedicated to the public domain under the Creative Commons Zero license."),
    ("artistic", "Licensed under the Artistic License 2.0. This program is distributed under the terms of the Artistic License. This is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at https://scripts.sil.org/OFL Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software."),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. This program is free software, it comes without any warranty, to the extent permitted by applicable law, you can redistribute it under the terms of the Do What The Fuck You Want To Public License, Version 2. Licensed under the WTFPL."),
    ("odbl", "This database is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License. Licensed under the ODbL 1.0."),
    ("psf", "Licensed under the Python Software Foundation License Version 2. Licensed to PSF under a Contributor Agreement. Released under the PSF license agreement."),
    ("ms-pl", "This source is subject to the Microsoft Public License. Licensed under the Microsoft Public License (Ms-PL). Released under the Ms-PL."),
    ("openssl", "Licensed under the OpenSSL License. This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit, redistributed under the OpenSSL license."),
]
# Creative Commons licences by family, in short and in words; identifiers of SPDX by family.
COMMONS = {"cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nd": "Attribution-NoDerivatives", "cc-by-nc": "Attribution-NonCommercial", "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
SPDX = {"apache": "Apache-2.0", "mit": "MIT", "bsd": "BSD-3-Clause", "isc": "ISC", "zlib": "Zlib", "boost": "BSL-1.0", "gpl": "GPL-3.0-or-later", "lgpl": "LGPL-2.1-only", "agpl": "AGPL-3.0-only", "gfdl": "GFDL-1.3", "mpl": "MPL-2.0", "epl": "EPL-2.0", "eupl": "EUPL-1.2", "cddl": "CDDL-1.0", "unlicense": "Unlicense", "cc0": "CC0-1.0", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nd": "CC-BY-ND-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-nc-sa": "CC-BY-NC-SA-4.0", "cc-by-nc-nd": "CC-BY-NC-ND-4.0", "artistic": "Artistic-2.0", "ofl": "OFL-1.1", "wtfpl": "WTFPL", "odbl": "ODbL-1.0", "psf": "PSF-2.0", "ms-pl": "MS-PL", "openssl": "OpenSSL"}
# Sentences that grant under terms of no family here, and sentences that speak of licences and grant none.
STRANGE = [
    "Licensed under the terms of the vendor licence agreement that came with this product.", "This software is licensed, not sold, under its own licence.", "Use is subject to license terms.", "See the LICENSE file for the license of this file.", "All rights reserved.", "Copyright 2019 the authors, all rights reserved.", "Licensed under the Example Corporation Source License, version 1.", "Permission to copy is granted under the licence of the publisher.", "You may redistribute this file under the terms of its license.", "Distributed under the Sample Community License.", "This work is licensed under a license of its own.", "Released under the Contoso Public License.", "THE SOFTWARE IS PROVIDED WITHOUT WARRANTY.", "The authors make no warranty and accept no liability.", "This program is licensed under the Shareware License.", "SPDX-License-Identifier: LicenseRef-Custom", "Licensed under the Server Side Public License.", "Licensed under the Business Source License 1.1.",
]
PLAIN = [
    "He lost his driving licence last week.", "The licence fee was due in March.", "Copyright law has changed many times since.", "The car comes with a five-year warranty.", "She gave her permission to leave early.", "A patent was filed for the device.", "The board discussed the open source licence question at length.", "The company holds a trademark in Europe.", "They asked for permission to use the hall.", "Under the new law a fishing license costs more.", "The minister denied any liability for the accident.", "The court ruled that no licence had been granted.", "Is the MIT campus open today?", "The Apache helicopter landed in the field.", "Boost your sales with this offer.", "The eclipse was seen by the public.", "The work was free of charge for members.", "The land passed into the public domain in the thirties.", "The licence holder must appear in person.", "A warrant was issued for his arrest.", "The restaurant lost its liquor license.", "The developers compared several licences and chose none.", "We sell it as is.", "Copyright owners complained about the site.", "The bank endorsed the plan.", "Attribution of the painting is disputed.", "Which license should I choose for my project?", "The agency waived the fee.", "Permits are sold at the gate.", "The pilot renewed her licence in May.", "The plates on the van carried a licence number.", "Infringement of copyright can lead to a fine.", "The king granted a licence to hold a market.", "A poet may take licence with grammar.", "The shop was licensed to sell tobacco.", "Her licence was revoked by the state.", "The clinic is licensed by the county.", "Copyright terms differ between countries.", "Liability rests with the owner of the dog.", "The seller gave no warranty on the used bike.", "Police searched the house with a warrant.", "He has a license to practise medicine.", "The film studio licensed the song for a trailer.", "We need permission from the council to build.", "The school requires written permission of a parent.", "A trademark dispute delayed the launch.", "The patent office rejected the claim.", "The author holds the copyright in the novel.", "The station lost its broadcast licence after complaints.", "As is usual in spring, the river rose.", "The gun licence law was debated.", "The company was found liable for damages.",
]


def templates() -> list[tuple[str, int, str]]:
    """(family, template, text) of all templates: the notices, and those that follow from a rule."""
    out = [*TEMPLATES]
    for family, words in COMMONS.items():
        short = f"CC {family[3:].upper()}"
        out += [(family, f"Text is available under the Creative Commons {words} License 3.0; additional terms may apply."), (family, f"This work is licensed under the Creative Commons {words.replace('NoDerivatives', 'NoDerivs')} 2.5 License.")]
        out += [(family, f"This work is licensed under a Creative Commons {words} 4.0 International License."), (family, f"Licensed under {short} 4.0."), (family, f"This work is licensed under {short} 3.0, a Creative Commons {words} 3.0 Unported License."), (family, f"To view a copy of this license, visit http://creativecommons.org/licenses/{family[3:]}/4.0/ Creative Commons {words}."), (family, f"Except where otherwise noted, content is available under {short} 4.0 ({words} 4.0 International).")]
    out += [(family, f"SPDX-License-Identifier: {name}") for family, name in SPDX.items()]
    out += [(family, f"Licensed under the {family.upper()} license.") for family in ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "eupl", "cddl")]
    gnu = {"gpl": ("GPL", ("2.0", "3.0")), "lgpl": ("LGPL", ("2.0", "2.1", "3.0")), "agpl": ("AGPL", ("3.0",)), "gfdl": ("GFDL", ("1.2", "1.3"))}
    more = [(family, f"{name}-{version}-{end}") for family, (name, versions) in gnu.items() for version in versions for end in ("only", "or-later")]
    more += [(family, f"{family.upper()}-{version}") for family in COMMONS for version in ("2.0", "2.5", "3.0")]
    more += [("bsd", "BSD-2-Clause"), ("apache", "Apache-1.1"), ("mpl", "MPL-1.1"), ("epl", "EPL-1.0")]
    out += [(family, f"SPDX-License-Identifier: {name}") for family, name in more if name != SPDX[family]]
    return [(family, k, text) for k, (family, text) in enumerate(out)]


def sentences_of(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE), lambda s: F.lower(s).rlike(MARKS))


def _with_grams(rows: DataFrame, of: str = "sentence") -> DataFrame:
    """words of a sentence, pairs (neighbours joined by a space), grams (both, each once)."""
    words = rows.withColumn("words", F.array_remove(F.split(F.lower(of), GAP), ""))
    pairs = words.withColumn("pairs", F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    return pairs.withColumn("grams", F.array_distinct(F.concat("words", "pairs")))


def marked_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, sentences): every row with its sentences that have a mark, written once; row is its number there."""
    text = F.col(text_col)
    some = F.when(F.lower(text).rlike(MARKS), sentences_of(text)).otherwise(F.array().cast("array<string>"))
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), some.alias("sentences")))


def _training(spark: SparkSession, known: list[tuple[str, int, str]]) -> DataFrame:
    """(family, template, sentence): sentences of the templates and the two halves of long ones; what several families share
    is UNKNOWN, as STRANGE is, and PLAIN is NONE. Each of those two counts as a template a sentence."""
    rows = spark.createDataFrame(known, "family string, template int, text string").select("family", "template", F.explode(sentences_of(F.col("text"))).alias("sentence"))
    words = F.split("sentence", r"\s+")
    half = F.floor(F.size(words) / 2).cast("int")
    part = lambda a, n: F.concat_ws(" ", F.slice(words, a, n))
    pieces = rows.select("family", "template", F.explode(F.when(half >= 8, F.array("sentence", part(F.lit(1), half), part(half + 1, F.size(words)))).otherwise(F.array("sentence", F.concat(F.lit("Copyright 2020 the authors. "), "sentence")))).alias("sentence"))
    plain = F.array_join(F.array_remove(F.split(F.lower("sentence"), GAP), ""), " ")
    shared = pieces.withColumn("plain", plain).withColumn("families", F.size(F.collect_set("family").over(Window.partitionBy("plain"))))
    own = shared.where("plain <> ''").select(F.when(F.col("families") > 1, UNKNOWN).otherwise(F.col("family")).alias("family"), "template", "sentence")
    more = [(UNKNOWN, 1000 + k, s) for k, s in enumerate(STRANGE)] + [(NONE, 2000 + k, s) for k, s in enumerate(PLAIN)]
    return own.distinct().union(spark.createDataFrame(more, "family string, template int, sentence string"))


def _weights(known: list[tuple[str, list[str]]]) -> tuple[dict[str, float], dict[str, float]]:
    """Weight of each gram by how few families have it; sum of weights of each template sentence is taken later."""
    having = defaultdict(set)
    for family, grams in known:
        for g in grams:
            having[g].add(family)
    n = len({f for f, _ in known})
    return {g: math.log((n + 1) / len(fs)) if len(fs) < n / 2 else 0.0 for g, fs in having.items()}, {"": math.log(n + 1)}


class Classifier:
    """The fitted model with its threshold, vocabulary, families, and the templates' sentences by gram."""

    def __init__(self, spark: SparkSession, plain: DataFrame, known: list[tuple[str, int, str]], max_plain: int):
        training = _training(spark, known)
        sample = plain.orderBy(F.xxhash64("sentence"), "sentence").limit(max_plain).select(F.lit(NONE).alias("family"), (F.lit(3000) + F.pmod(F.xxhash64("sentence"), F.lit(1000))).cast("int").alias("template"), "sentence")
        rows = materialize(_with_grams(training.union(sample)).select("family", "template", "sentence", "grams", "pairs").coalesce(1))
        licence = [r for r in rows.where(F.col("template") < 1000).select("family", "template", "sentence", "grams").collect()]  # bounded by the templates
        strange = rows.where((F.col("template") >= 1000) & (F.col("template") < 3000)).select("grams").collect()
        self.vocabulary = sorted({g for r in licence for g in r["grams"]} | {g for r in strange for g in r["grams"]})
        self.families = [NONE, UNKNOWN, *sorted({f for f, *_ in known})]
        self.count = CountVectorizerModel.from_vocabulary(self.vocabulary, "grams", "features")
        self.count.setBinary(True)
        label = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")).cast("double") - 1
        weight = F.when(F.col("template") >= 3000, F.lit(1.0)).otherwise(F.lit(10.0))
        seen = self.count.transform(rows).withColumn("label", label).withColumn("weight", weight).withColumn("fold", F.pmod(F.xxhash64("template"), F.lit(FOLDS)))
        learner = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, tol=1e-4, weightCol="weight")
        by_gram, _ = _weights([(r["family"], r["grams"]) for r in licence if r["family"] != UNKNOWN])
        self.spark, self.odd = spark, math.log(len(self.families))
        self.grams = spark.createDataFrame(sorted(by_gram.items()), "gram string, weight double")
        own = [(r["family"], r["template"], k, g) for k, r in enumerate(licence) if r["family"] != UNKNOWN for g in r["grams"]]
        self.inverted = spark.createDataFrame(own, "family string, template int, line int, gram string").join(self.grams, "gram").where("weight > 0")
        self.inverted = materialize(self.inverted.join(self.inverted.groupBy("line").agg(F.sum("weight").alias("total")), "line"))
        wrong = []
        for fold in range(FOLDS):
            model = learner.fit(seen.where(F.col("fold") != fold))
            held = model.transform(seen.where((F.col("fold") == fold) & (F.col("template") < 3000))).withColumn("p", vector_to_array("probability"))
            best = F.array_max("p")
            off = held.select(best.alias("p"), (F.array_position("p", best).cast("int") - 1).alias("guess"), F.col("label").cast("int").alias("label"))
            wrong.append(off.where((F.col("guess") != F.col("label")) & (F.col("guess") > 1)).agg(F.percentile("p", F.lit(0.9)).alias("p")).first()["p"])
        self.threshold = min(MOST, max(LEAST, *(w or 0.0 for w in wrong)))
        self.model = learner.fit(seen)

    def score(self, rows: DataFrame) -> DataFrame:
        """rows(key, sentence) -> adds guess, probability of the guess, p_none and p."""
        p = self.model.transform(self.count.transform(_with_grams(rows))).withColumn("p", vector_to_array("probability"))
        best = F.array_max(F.slice("p", 2, len(self.families) - 1))
        names = F.array(*map(F.lit, self.families))
        found = p.withColumns({"p_none": F.col("p")[0], "probability": best})
        return found.withColumn("guess", names[F.array_position(F.slice("p", 2, len(self.families) - 1), best).cast("int")])

    def agreement(self, scored: DataFrame, key: str) -> DataFrame:
        """(key, similarity, rival) of scored rows: twice the common weight over the sum of both sides' for the best template
        sentence of the guessed family, and the same for the best of any other. Pairs of a word and "license" that no
        template has weigh against all: they name some other licence."""
        rows = scored.where(~F.col("guess").isin(NONE, UNKNOWN)).select(key, "guess", F.explode("grams").alias("gram"))
        odd = rows.join(F.broadcast(self.grams), "gram", "left").withColumn("weight", F.coalesce("weight", F.when(F.col("gram").rlike(r"^[a-z0-9+]+ licen[cs]e$") & ~F.col("gram").rlike(r"^(?:the|this|a|an|of|and|or|for|by|following|copyright|same|above|new|[0-9]+) "), F.lit(self.odd)).otherwise(0.0)))
        size = odd.groupBy(key).agg(F.sum("weight").alias("size"))
        shared = rows.join(F.broadcast(self.inverted), "gram").groupBy(key, "guess", "family", "line").agg(F.sum("weight").alias("common"), F.first("total").alias("total"))
        both = shared.join(size, key).withColumn("s", 2 * F.col("common") / (F.col("total") + F.col("size")))
        own = F.col("family") == F.col("guess")
        return both.groupBy(key).agg(F.coalesce(F.max(F.when(own, F.col("s"))), F.lit(0.0)).alias("similarity"), F.coalesce(F.max(F.when(~own, F.col("s"))), F.lit(0.0)).alias("rival"))


def licence_names(sentence: Column) -> Column:
    """What a sentence of several licences says of each, as a sentence of its own; names of over eight words are left out."""
    spdx = F.lower(sentence).rlike("spdx-license-identifier:")
    names = F.transform(F.split(F.regexp_replace(sentence, "(?i)spdx-license-identifier:", ""), BETWEEN), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), BEFORE, ""), BEFORE, "")))
    short = F.filter(names, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= 8))
    return F.transform(short, lambda x: F.when(spdx, F.concat(F.lit("SPDX-License-Identifier: "), x)).otherwise(F.concat(F.lit("Licensed under the "), x, F.when(F.lower(x).rlike("licen[cs]e"), "").otherwise(" License"), F.lit("."))))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_plain: int = MAX_PLAIN) -> tuple[DataFrame, DataFrame]:
    """(found, marked). found(row, place, sentence, family, probability, similarity, confirmed) has every sentence that is more
    likely a licence than none; family is UNKNOWN where probability and comparison do not confirm one. A sentence that is not
    confirmed and speaks of several licences is judged name by name, and has a row for each family that is. A sentence that
    denies a licence, or names one without granting anything, confirms none. marked(row, doc_id, sentences) has all rows of docs.

    Null and empty texts have no sentences; repeated rows and ids, and rows without an id, are rows of their own; an empty
    table gives empty results. Every sentence of every text is looked at; only the sample for the fit is bounded."""
    marked = marked_sentences(docs, id_col, text_col)
    lines = marked.select("row", F.posexplode("sentences").alias("place", "sentence"))
    quiet = lines.where(~F.lower("sentence").rlike(SURE_MARKS))
    found = Classifier(docs.sparkSession, quiet, templates(), max_plain)

    def judged(rows: DataFrame) -> DataFrame:
        compared = rows.join(found.agreement(rows, "key"), "key", "left")
        sure = F.coalesce((F.col("guess") != UNKNOWN) & (F.col("probability") >= found.threshold) & (F.col("similarity") >= SIMILAR) & (F.col("similarity") >= F.col("rival") + MARGIN), F.lit(False))
        return compared.select("row", "place", "sentence", F.when(sure & F.col("grants"), F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", (sure & F.col("grants")).alias("confirmed"), "grants")

    key, low = F.monotonically_increasing_id(), F.lower("sentence")
    scored = materialize(found.score(lines).where("p_none < 0.5").select("row", "place", "sentence", "grams", "guess", "probability", (low.rlike(GRANTS) & ~low.rlike(DENIES)).alias("grants")).withColumn("key", key))
    whole = materialize(judged(scored))
    several = whole.where(~F.col("confirmed") & F.col("grants") & F.col("sentence").rlike(SEVERAL)).select("row", "place", F.col("sentence").alias("said"), "grants", F.explode(licence_names(F.col("sentence"))).alias("sentence"))
    names = materialize(found.score(several).where("p_none < 0.5").select("row", "place", "said", "grants", "sentence", "grams", "guess", "probability").withColumn("key", key))
    each = judged(names).where("confirmed").join(names.select("row", "place", "said").distinct(), ["row", "place"])
    each = each.groupBy("row", "place", F.col("said").alias("sentence"), "family").agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity")).withColumn("confirmed", F.lit(True))
    whole = whole.drop("grants")
    return whole.join(each.select("row", "place").distinct(), ["row", "place"], "left_anti").unionByName(each), marked


def document_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licences, n_confirmed, n_unknown) of every row: its confirmed families in order, joined by commas (none:
    empty), and its numbers of confirmed and unknown licence sentences."""
    found, marked = classify(docs, id_col, text_col)
    by_row = found.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"), F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"), F.count(F.when(~F.col("confirmed"), 1)).alias("n_unknown"))
    return marked.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
