import random

import corpus_pipeline
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 9))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [text(30) for _ in range(5)]
    texts, toxic = {}, {}
    for i in range(300):
        texts[i] = text(r.randint(30, 120))
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            words = texts[i].split()
            for _ in range(8):
                words.insert(r.randrange(len(words)), r.choice(["vilespeak", "grumblord", "nastifoo"]))
            texts[i] = " ".join(words)
    for i in range(300, 320):
        texts[i] = "Subscribe to our letter!\n" + text(60)
    for i in range(320, 330):
        texts[i] = texts[i - 300 + 1]  # copies of 21 to 30
    for i in range(330, 340):
        texts[i] = text(20) + " " + items[i % 5] + " " + text(20)
    texts[340], texts[341] = None, ""
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i in texts if not toxic.get(i) and not 320 <= i < 340}
    clean |= {i for i in range(320, 330) if toxic[i - 299]} & set()
    missed = {i for i in got if i not in clean}
    assert len(missed) <= 3 and all(toxic.get(i) or toxic.get(i - 299) for i in missed)
    assert clean <= set(got)
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    for i in clean:
        left = "\n".join(x for x in (texts[i] or "").split("\n") if x != "Subscribe to our letter!")
        assert list(got[i].ids) == library.encode(left, add_special_tokens=False).ids
