import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\f\r"


def make_texts(n, seed=1, words=400):
    """Invented texts: words of a small vocabulary, lines, sentences, long and short ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(words)]
    out = []
    for _ in range(n):
        size = int(r.lognormvariate(4, 1.2)) + 1
        text = ""
        for _ in range(size):
            w = r.choice(vocabulary)
            text += (w.title() if r.random() < 0.1 else w) + r.choice([" ", " ", " ", ". ", "\n", ", "])
        out.append(text)
    return out


#: Nulls, empty and blank texts, no letters, other scripts, marks, every kind of ASCII white space.
ODD = [None, "", " ", "\n\n", "123 !!", "a", "Ünïcode ÄÖ ß ﬁ", "日本語 テキスト", "x y z", "a\x0bb\x0cc\rd\te", "<|endoftext|> a", "nul\x00byte", "🙂 🙃"]


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of documents: (doc_id, text) with languages and sources, or full rows."""

    def make(rows):
        full = [r if len(r) == 5 else (r[0], r[1], "en", f"s{(r[0] or 0) % 5}", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus(frame):
    """Texts with exact and near copies, odd ones and a very long one, as a list of (doc_id, text) and a frame."""
    r = random.Random(5)
    texts = make_texts(150)
    texts += texts[:12] + texts[:3]
    for t in texts[20:50]:
        w = t.split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += ODD + [" ".join(f"w{k % 977}" for k in range(30_000))]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows, frame(rows)
