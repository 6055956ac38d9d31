import hashlib
import random
from collections import Counter

from wayfunnel.llm import lines


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_against_brute_force(spark):
    r = random.Random(5)
    pool = ["Common É line", "  common É line\t", "another", "É", "é", "", " \t", "x" * 5000] + [f"line {i}" for i in range(300)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(120)] + [None, "", "\n", "a\r\nb", "another"]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)] + [(4, texts[4], "z", 1)],
                                 "doc_id long, text string, low string, n int")
    texts.append(texts[4])
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} - {""})
    for batches, least in ((4, 10), (1, 3), (7, 5)):
        got = lines.common_lines(docs, least, batches=batches).collect()
        assert len(got) == len(texts)
        expected = Counter()
        for i, t in enumerate(texts):
            own = (t or "").split("\n")
            left = "\n".join(x for x in own if count[key(x)] < least)
            gone = sum(count[key(x)] >= least for x in own)
            expected[4 if i == len(texts) - 1 else i, len(own), gone, left, hashlib.sha256(left.encode()).hexdigest()] += 1
        assert Counter((x.doc_id, x.n_lines, x.n_dropped, x.kept, x.kept_sha256) for x in got) == expected
        whole = lines.without_common_lines(docs, least, batches=batches)
        assert whole.columns == docs.columns
        assert Counter((x.doc_id, x.text or "") for x in whole.collect()) == Counter((k[0], k[3]) for k in expected.elements())
    assert lines.common_lines(docs.limit(0)).count() == 0
