"""Kernels against published values."""

import math

import numpy as np
import pytest

from cladespark.functions.alphabet import DNA, Alphabet
from cladespark.operators.distance import kimura_dna, log_det, pair_matrix
from cladespark.operators.joining import neighbor_joining, relaxed, relaxed_joining
from cladespark.operators.likelihood import Model, site_lnl
from cladespark.operators.trees import canonize, collapse, deroot, rebase
from cladespark.sources import fasta, newick, phylip


def masks(text):
    return np.array([DNA.values()[c] for c in text])


def matrix(n, upper):
    d = np.zeros((n, n))
    d[np.triu_indices(n, 1)] = upper
    return d + d.T


def shape(text):
    """Splits with lengths: what a tree is, apart from its drawing."""
    rows = newick.parse(text)
    taxa = sorted(r[3] for r in rows if r[5])
    below = {r[0]: {r[3]} if r[5] else set() for r in rows}
    for r in reversed(rows):
        if r[1] is not None:
            below[r[1]] |= below[r[0]]
    out = {}
    for r in rows:
        if r[1] is not None:
            side = below[r[0]] if taxa[0] not in below[r[0]] else set(taxa) - below[r[0]]
            out[tuple(sorted(side))] = round(out.get(tuple(sorted(side)), 0) + r[4], 4)
    return out


@pytest.mark.parametrize("a,b,want", [("A", "C", 14680.19), ("A", "G", 55571.19), ("A", "K", 11.01), ("C", "Y", 1.46), ("S", "B", 1.26)])
def test_kimura(a, b, want):
    assert kimura_dna(pair_matrix(masks(a * 20), masks(b * 20), 4)) == pytest.approx(want, abs=0.006)


def test_log_det_of_a_missing_state():
    assert math.isnan(log_det(pair_matrix(masks("ACG"), masks("CAG"), 4)))


@pytest.mark.parametrize("how", [neighbor_joining, relaxed_joining])
def test_joining(how):
    four = how(matrix(4, [8, 7, 12, 9, 14, 11]), list("ABCD"))
    assert shape(four) == shape("(A:3,B:5,(C:3,D:8):1);")
    eight = [4, 13, 13, 10, 14, 25, 23, 15, 15, 12, 16, 27, 25, 16, 7, 11, 22, 20, 13, 17, 28, 26, 6, 17, 15, 17, 15, 10]
    want = shape("(A:1,B:3,((C:5,(E:1,(F:3,(G:6,H:4):8):2):1):3,D:8):4);")
    d = matrix(8, eight)
    for seed in range(5):
        p = np.random.default_rng(seed).permutation(8)
        assert shape(how(d[np.ix_(p, p)], ["ABCDEFGH"[i] for i in p])) == want


def test_labels_of_joined_trees_are_quoted_and_additivity_is_told():
    d = matrix(4, [8, 7, 12, 9, 14, 11])
    names = ["a (x)", "b_c", "d e", "f"]
    for text in (neighbor_joining(d, names), relaxed_joining(d, names)):
        assert {r[3] for r in newick.parse(text) if r[5]} == set(names)
    assert relaxed(d, names)[1]
    rng = np.random.default_rng(3)
    p = rng.random((30, 2))
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    text, additive = relaxed(far, [f"t{i}" for i in range(30)])
    assert not additive and len({r[3] for r in newick.parse(text) if r[5]}) == 30
    assert relaxed(far, [f"t{i}" for i in range(30)], np.random.default_rng(1))[0].count(",") == 29


# A five-taxon tree and its alignment with published likelihoods.
FIVE = "(A:0.1,B:0.1,(C:0.25,(D:0.2,E:0.3):0.1):0.4);"
ROWS = ["ATA", "CTA", "CAT", "GAT", "GTR"]
COLUMNS = ["".join(c) for c in zip(*ROWS, strict=True)]


def test_likelihood():
    got = site_lnl(FIVE, list("ABCDE"), COLUMNS, [Model()])
    assert got == pytest.approx([-8.591872, -6.490368, -5.898628], abs=1e-6)


@pytest.mark.parametrize("alpha,mean,median", [(0.5, -21.91979, -21.78182), (1, -21.52568, -21.44264), (5, -21.11582, -21.09430), (300, -20.98329, -20.98288)])
def test_gamma(alpha, mean, median):
    for m, want in ((False, mean), (True, median)):
        assert site_lnl(FIVE, list("ABCDE"), COLUMNS, [Model(alpha=alpha, ncat=4, median=m)]).sum() == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("p,want", [(0, -11.26943), (0.25, -11.60745), (0.5, -12.34130), (0.75, -14.07411)])
def test_invariant_sites(p, want):
    assert site_lnl("(A:0,B:0,C:1.25);", list("ABC"), ["AAA", "CCA", "GGA", "TTA"], [Model(pinvar=p)]).sum() == pytest.approx(want, abs=1e-5)


def test_newick():
    assert newick.render(newick.parse("(A,'B B','C''C');")) == "(A,B_B,'C''C');".replace("B_B", "B_B")
    assert newick.render(newick.parse("[x[y]](A_B:1e2 , (C,D)e:-.5)".replace("-.5", "-0.5") + ";"), lengths=True, fmt="%g") == "(A_B:100,(C:0,D:0)e:-0.5);"
    for bad in ("(A:42.);", "(A,B;", "(A B);", "(A,B)", "A);", "(c:2,b:1,a (x):1);", "((A,B)(C,D));"):
        with pytest.raises(ValueError):
            newick.parse(bad)


def test_trees():
    rows = newick.parse("(A:1,((B:1,C:-1):0,D:2):1);")
    got, n = collapse(rows)
    assert n == 1 and newick.render(canonize(got), lengths=True, fmt="%g") == "(A:1,(B:1,C:0,D:2):1);"
    assert shape(newick.render(deroot(newick.parse("(A:3,(B:1,C:2):3);")), lengths=True)) == shape("(A:6,B:1,C:2);")


def test_rebase():
    text = "(B:1,((D:2,A:3):4,C:5):6);"
    got = rebase(newick.parse(text))
    assert newick.render(got, lengths=True, fmt="%g").startswith("(A:3,") and shape(newick.render(got, lengths=True)) == shape(text)
    assert shape(newick.render(rebase(newick.parse(text), "C"), lengths=True)) == shape(text)
    with pytest.raises(ValueError):
        rebase(newick.parse(text), "Z")


def test_fasta_and_phylip():
    assert fasta.parse(">a_b note\nAC GT\n\nNN\n>c\n-\n") == [("a b", "ACGTNN"), ("c", "-")]
    for bad in (">", "> x\nA", ">a\n>b\nA", ">a\nZ"):
        with pytest.raises(ValueError):
            fasta.parse(bad)
    want = (["A", "B", "C"], [(0, 1, 1.0), (0, 2, 2.5), (1, 2, 3.0)])
    assert phylip.parse("3\nA 0 1 2.5\nB 1 0 3\nC 2.5 3 0") == phylip.parse("3\nA 1 2.5\nB 3\nC") == phylip.parse("3\nA\nB 1\nC 2.5 3") == want
    with pytest.raises(ValueError):
        phylip.parse("2\nA 0 1\nB 2 0")


def test_alphabet():
    x = Alphabet("x", "ABCD", {"W": "AB", "X": "ABC", "Y": "CD"}, {"a": "A"}, "Z")
    assert [x.values()[c] for c in "WXYZa-"] == [3, 7, 12, 15, 1, 0]
    with pytest.raises(ValueError):
        Alphabet("x", "AA", {}, {}, "Z")
    with pytest.raises(ValueError):
        Alphabet("x", "AB", {"W": "AQ"}, {}, "Z")
