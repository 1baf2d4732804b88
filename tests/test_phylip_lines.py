"""Matrices read line by line against the reader of whole texts."""

import pytest

from cladespark.sources import phylip

NAMES = ["a", "b c", "_d", "e.1"]
D = [[0, 1, 2.5, 3], [1, 0, 4, 5e-1], [2.5, 4, 0, 6], [3, 5e-1, 6, 0]]


def text(kind, d=D, names=NAMES):
    n = len(names)
    span = {"full": lambda r: range(n), "upper": lambda r: range(r + 1, n), "lower": lambda r: range(r)}[kind]
    return [str(n)] + [" ".join([names[r], *(str(d[r][c]) for c in span(r))]) for r in range(n)]


def lines(spark, given):
    return spark.createDataFrame([(k - 1, x) for k, x in enumerate(given)], "row long, line string").repartition(3)


@pytest.mark.parametrize("kind", ["full", "upper", "lower"])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_layouts(spark, kind, n):
    # Without line ends a whole text of two taxa can't tell a label of two words from two labels.
    names = [x.replace(" ", "_") if n == 2 else x for x in NAMES[:n]]
    given = text(kind, [r[:n] for r in D[:n]], names)
    got = sorted(map(tuple, phylip.scan_lines(lines(spark, given)).collect()))
    want = [(i, j, names[i], names[j], float(D[i][j])) for i in range(n) for j in range(i + 1, n)]
    assert got == want
    labels, cells = phylip.parse("\n".join(given))
    assert cells == [(i, j, d) for i, j, _, _, d in want] and labels == names


@pytest.mark.parametrize("change", [lambda t: t[1:], lambda t: t[:-1], lambda t: [*t[:-1], t[-1] + " 1"], lambda t: [*t[:-1], t[1]], lambda t: [*t[:2], t[2].replace("1 ", "9 ", 1), *t[3:]], lambda t: [t[0], t[1].replace(" 0", " 7", 1), *t[2:]]])
def test_errors(spark, change):
    with pytest.raises(Exception):  # noqa: B017
        phylip.scan_lines(lines(spark, change(text("full")))).collect()
