import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, h string, w int, start long, spans string, id long"


def corpus():
    """Near copies at many distances, shared passages, repeated lines, nulls, empty and very long texts, hot sources."""
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in ("ba", "Ko", "mí", "sté", "ru") for b in ("la", "no", "ti") for c in ("s", "m,", "", "9", "-X")]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = []
    passage = say(45)
    for i in range(60):
        w = say(rng.choice((3, 15, 60, 200)))
        texts.append(w)
        if i % 4 == 0:
            for cut in (0, 1, 2, 5):
                near = list(w)
                for _ in range(cut):
                    near[rng.randrange(len(near))] = rng.choice(vocab)
                texts.append(near)
        if i % 5 == 0:
            texts.append(say(12) + passage + say(9))
    texts.append(say(6000))
    texts.append(passage * 4)
    out = [" ".join(w) for w in texts]
    out += [None, "", " \n\t ", "one", "One two", "one two", "  x y", "a b c\n" * 12, "line one\nline one\n\nline two " + " ".join(say(30)), "$$$ ### " + " ".join(say(12))]
    rng.shuffle(out)
    return [(7 * i + 3, t, (None, "en", "fr")[i % 3], "hot" if i % 3 else None, len(t or ""), 1, "x", 2, 3, "y", 4) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
