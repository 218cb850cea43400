"""Kernels against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ampliframe.functions import align as al
from ampliframe.functions.stats import abundance_pvalue, loess, poisson_upper_tail
from ampliframe.operators.denoise import Partition, mean_qualities
from ampliframe.operators.errors import binned_rates, default_model, loess_rates, noqual_matrix
from ampliframe.operators.reads import find_primer, find_primer_indels, trimmed
from ampliframe.operators.tables import coverage, merge_pair
from ampliframe.params import BimeraParams, DenoiseParams, LearnParams, MergeParams, PrimerParams

dna = st.text("ACGT", min_size=3, max_size=24)


def plain_alignment(a, b, s, free):
    n1, n2 = len(a), len(b)
    lw, rw = al._band(n1, n2, s.band)
    score, step = {}, {}
    border = 0 if free else s.gap
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if i and j:
                if j < i - lw or j > i + rw:
                    continue
                get = lambda x: score.get(x, -9999)
                left = get((i, j - 1)) + (0 if free and i == n1 else s.gap)
                up = get((i - 1, j)) + (0 if free and j == n2 else s.gap)
                diag = get((i - 1, j - 1)) + (s.match if a[i - 1] == b[j - 1] else s.mismatch)
                best = (up, 3) if up >= diag and up >= left else (left, 2) if left >= diag else (diag, 1)
                score[i, j], step[i, j] = best
            else:
                step[i, j] = 3 if i else 2
                if (i <= lw) if i else (j <= rw):
                    score[i, j] = border * (i + j)
    i, j, x, y = n1, n2, "", ""
    while i or j:
        p = step[i, j]
        x, y = (a[i - 1] if p != 2 else "-") + x, (b[j - 1] if p != 3 else "-") + y
        i, j = i - (p != 2), j - (p != 3)
    return x, y


@settings(max_examples=150, deadline=None)
@given(dna, dna, st.sampled_from([-1, 3, 16]), st.booleans())
def test_alignment_equals_the_plain_recurrence(a, b, band, free):
    s = al.Scoring(band=band)
    assert al.align(a, b, s, free) == plain_alignment(a, b, s, free)


def test_batch_equals_single():
    rng = random.Random(5)
    first = "".join(rng.choices("ACGT", k=40))
    many = ["".join(rng.choices("ACGT", k=rng.choice([38, 40, 44]))) for _ in range(30)]
    got = al.align_many(al.encoded(first), [al.encoded(m) for m in many])
    assert [(x.tobytes().decode(), y.tobytes().decode()) for x, y in got] == [al.align(first, m) for m in many]


def test_homopolymer_gaps_are_cheaper():
    x, y = al.align("ACGTTTTTACG", "ACGTTTTACG", al.Scoring(homopolymer_gap=-1))
    assert len(x) == 11 and y.count("-") == 1 and y.index("-") in range(3, 8)


def test_substitutions_skip_gaps_and_ambiguous_bases():
    subs = al.substitutions(al.encoded("AC-GTN"), al.encoded("AGTG-C"))
    assert subs.ref_positions.tolist() == [1] and subs.query_positions.tolist() == [1]
    assert subs.position_map.tolist() == [0, 1, 3, al.NO_POSITION, 4]


def test_evaluation_leaves_out_terminal_gaps():
    assert al.evaluate(al.encoded("--ACGT"), al.encoded("TTAGG-")) == (2, 1, 0)
    assert al.evaluate(al.encoded("---"), al.encoded("ACG")) == (0, 0, 0)


def test_kmer_distances():
    a, b = al.encoded("ACGTACGT"), al.encoded("ACGTTCGT")
    va, vb = al.kmer_vector(a, 3), al.kmer_vector(b, 3)
    shared = int(np.minimum(va, vb).sum())
    assert al.kmer_distances(va, 8, vb[None], np.array([8]), 3)[0] == pytest.approx(1 - shared / 6)
    assert al.ordered_distance(al.ordered_kmers(a, 3), al.ordered_kmers(b, 3)) == pytest.approx(1 - 3 / 6)
    assert al.kmer_vector(al.encoded("ACNGT"), 3).sum() == 0


@pytest.mark.parametrize(("k", "mu"), [(1, 0.5), (3, 1.0), (40, 50.0), (60, 50.0), (5, 1e-4)])
def test_poisson_tail(k, mu):
    import math

    plain = 1 - math.fsum(math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1)) for i in range(k))
    assert poisson_upper_tail(k, mu) == pytest.approx(plain, abs=1e-13)


def test_pvalue_limits():
    assert poisson_upper_tail(0, 3.0) == 1 and abundance_pvalue(4, 0.0) == 0
    assert abundance_pvalue(1, 1e-9) == pytest.approx(1.0)
    assert abundance_pvalue(2, 1e-9) == pytest.approx(5e-10, rel=1e-6)
    assert abundance_pvalue(2, 1e-9, prior=True) == pytest.approx(5e-19, rel=1e-6)


def test_loess_reproduces_lines_and_levels_off_outside():
    x = np.arange(20.0)
    for surface in ("direct", "interpolate"):
        got = loess(x, 2 * x + 1, np.ones(20), [-5, 0, 7.5, 19, 40], surface=surface)
        assert got == pytest.approx([1, 1, 16, 39, 39])
    assert np.isnan(loess([], [], [], [1.0])).all()


def test_mean_quality_rounds_halves_up():
    assert mean_qualities(np.array([5, 7, 9]), 2).tolist() == [3, 4, 5]


def sample(err_rate=0.0, seed=3):
    rng = random.Random(seed)
    a = "".join(rng.choices("ACGT", k=60))
    b = a[:20] + {"A": "C", "C": "A", "G": "T", "T": "G"}[a[20]] + a[21:]
    far = "".join(rng.choices("ACGT", k=60))
    return a, b, far


def test_partition_separates_variants_and_conserves_reads():
    a, b, far = sample()
    one_off = a[:30] + {"A": "C", "C": "G", "G": "T", "T": "A"}[a[30]] + a[31:]
    seqs, reads = [a, b, far, one_off], np.array([1000, 400, 300, 1])
    part = Partition(seqs, reads, [np.full(60, 38)] * 4, np.zeros(4, bool), default_model(41), DenoiseParams()).run()
    assert sorted(part.cluster_reads) == [300, 400, 1001]
    assert sum(part.cluster_reads) == reads.sum()
    assert part.cluster_of[3] == part.cluster_of[0]
    assert {part.births[c]["type"] for c in range(3)} == {"Initial", "Abundance"}


def test_priors_are_split_off_on_weaker_evidence():
    a, b, _ = sample()
    run = lambda prior: len(Partition([a, b], np.array([1000, 3]), [np.full(60, 38)] * 2, np.array([False, prior]), default_model(41), DenoiseParams()).run().members)
    assert (run(False), run(True)) == (1, 2)


def test_other_symbols_are_an_error_that_says_what_to_do():
    with pytest.raises(ValueError, match="max_n"):
        Partition(["ACGTNACGT"], np.array([1]), [np.full(9, 30)], np.zeros(1, bool), default_model(41), DenoiseParams())


def test_rates_of_each_base_add_up_to_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (16, 41)).astype(float)
    counts[[0, 5, 10, 15]] += 10_000
    for rates in (loess_rates(counts), noqual_matrix(counts), binned_rates(counts, LearnParams(bins=(0, 10, 20, 40)))):
        assert rates.reshape(4, 4, -1).sum(axis=1) == pytest.approx(np.ones((4, 41)))
    with pytest.raises(ValueError, match="beyond the bins"):
        binned_rates(counts, LearnParams(bins=(10, 20)))


def test_primers():
    assert find_primer("TTACGTGG", "ACGT", 0) == (2, 6)
    assert find_primer("TTACGTGG", "RCGT", 0) == (2, 6)
    assert find_primer("CGTGG", "ACGT", 1) == (0, 3)  # one base hangs over the edge
    assert find_primer("GGGG", "ACGT", 1) is None
    assert find_primer_indels("TTACTGG", "ACGT", 1) is not None
    params = PrimerParams(forward="ACGTAC", max_mismatch=0)
    assert trimmed("ACGTACGGGTTT", "I" * 12, params) == ("GGGTTT", "IIIIII")
    assert trimmed("AAACCCGTACGT", "ABCDEFGHIJKL", params) == ("GGGTTT", "FEDCBA")
    assert trimmed("GGGGGGGGGGGG", "I" * 12, params) is None


def test_merging():
    rng = random.Random(2)
    whole = "".join(rng.choices("ACGT", k=64))
    mate = whole[20:].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    got = merge_pair(whole[:44], mate, MergeParams())
    assert (got["seq"], got["accept"], got["n_match"]) == (whole, True, 24)
    other = "".join(rng.choices("ACGT", k=44))
    assert not merge_pair(whole[:44], other, MergeParams())["accept"]
    assert merge_pair(whole[:44], other, MergeParams(rescue_unmerged=True))["concatenated"]


def test_chimera_coverage():
    query, parent = al.encoded("AAAACCCC"), al.encoded("AAAAGGGG")
    assert coverage(query, parent, BimeraParams())[:2] == (4, 0)
    assert coverage(query, al.encoded("AATACCCC"), BimeraParams(allow_one_off=True)) == (2, 5, 8, 8)
