import random
import re

from wayfunnel.llm import licenses


def labels(text):
    return [x.label for x in licenses.detections(licenses.tokens(text))]


def test_rules():
    assert len(licenses.rules()) >= 300
    assert labels("Licensed under the Apache License, Version 2.0 (the thing)") == ["apache-2.0"]
    assert labels("released under the MIT License.") == ["mit"]
    assert labels("This is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("GNU Lesser General Public License v2.1 or later") == ["lgpl-2.1-or-later"]
    assert labels("licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("Creative Commons Attribution-ShareAlike 3.0 and BSD 3-clause license") == ["cc-by-sa-3.0", "bsd-3-clause"]
    assert labels("SPDX-License-Identifier: MIT License; all rights reserved") == ["mit", "proprietary"]
    assert labels("nothing to see, a licensed driver") == []


def test_base_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = "gnu general public license apache cc by mit é 4 x".split()
    texts = ["".join(r.choice(vocabulary).upper() if r.random() < .3 else r.choice(vocabulary) + r.choice([" ", "-", "\n", "é", ""])
                     for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", "cc by cc by", "MIT  License"] + ["mit license"] * 2
    docs = spark.createDataFrame([(i if i < 205 else 204, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts)
    for row, text in zip(sorted(got, key=lambda x: x.doc_id), texts, strict=True):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0
