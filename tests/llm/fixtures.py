"""Small document tables for the text operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, words string"
WORDS = [a + b for a in "ka lo mi nu re sa to vi".split() for b in "n r s t l".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def document_rows(seed=1, n=60):
    """Ordinary texts, copies, near copies, nulls, blanks, repeated rows, one long text; extra columns clash on purpose."""
    rng = random.Random(seed)
    texts = [". ".join(sentence(rng, rng.randint(3, 14)).capitalize() for _ in range(rng.randint(1, 12))) for _ in range(n)]
    texts += [texts[3]] * 3 + [texts[5].replace(" ", "  ", 2), texts[7] + " end", texts[8].upper()]
    texts += [None, None, "", " \n\t ", "one", "Two words", "É è ñ 1st x_y", "a\nb\na\n\nb", sentence(rng, 30_000)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 0.5, True, "w") for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, texts[4], None, None, None, None, None, None), (None, None, None, "src1", None, None, None, None)]


def documents(spark, rows=None):
    return spark.createDataFrame(document_rows() if rows is None else rows, SCHEMA)
