"""Parameters of the operators, with their defaults. Every group is frozen; ``replace`` makes variants."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from ampliframe.functions.align import Scoring

# Fixed values of the method.
TAXONOMY_K, BOOTSTRAPS, MIN_QUERY = 8, 100, 50
LONGEST_SEQUENCE, MOST_SHUFFLES, HIGHEST_QUALITY = 9999, 10, 93
LEVELS = ("Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species")


@dataclass(frozen=True)
class FilterParams:
    """Read filter, in the order in which its steps apply; 0 or None switches a step off."""

    max_len: int = 0
    trim_left: int = 0
    trim_right: int = 0
    trunc_q: int = 2
    trunc_len: int = 0
    min_len: int = 20
    max_n: int | None = 0
    min_q: int = 0
    max_ee: float | None = None
    low_complexity: float = 0.0
    offset: int = 33


@dataclass(frozen=True)
class PrimerParams:
    forward: str = ""
    reverse: str = ""
    max_mismatch: int = 2
    allow_indels: bool = False
    trim_forward: bool = True
    trim_reverse: bool = True
    orient: bool = True
    filter: FilterParams | None = None


@dataclass(frozen=True)
class DenoiseParams:
    omega_a: float = 1e-40
    omega_c: float = 1e-40
    omega_p: float = 1e-4
    min_fold: float = 1.0
    min_hamming: int = 1
    min_abundance: int = 1
    detect_singletons: bool = False
    use_quals: bool = True
    use_kmers: bool = True
    kdist_cutoff: float = 0.42
    k: int = 5
    gapless: bool = True
    greedy: bool = True
    max_clusters: int = 0
    scoring: Scoring = Scoring()

    def resolve(self, inherited: dict | None = None, **given) -> DenoiseParams:
        """Given values before inherited ones before these; the threshold for keeping reads is never inherited."""
        known = {f.name for f in fields(self)}
        out = {k: v for k, v in (inherited or {}).items() if k in known and k != "omega_c"}
        return replace(self, **(out | {k: v for k, v in given.items() if v is not None}))


@dataclass(frozen=True)
class LearnParams:
    bases: float = 1e8
    seed: int | None = None
    max_rounds: int = 10
    model: str = "loess"
    pseudocount: float = 1.0
    bins: tuple[int, ...] = ()
    min_rate: float = 1e-7
    max_rate: float = 0.25
    denoise: DenoiseParams = DenoiseParams(omega_c=0.0)


@dataclass(frozen=True)
class MergeParams:
    min_overlap: int = 12
    max_mismatch: int = 0
    trim_overhang: bool = False
    just_concatenate: bool = False
    rescue_unmerged: bool = False
    return_rejects: bool = False
    spacer: int = 10
    scoring: Scoring = Scoring(match=5, mismatch=-4, gap=-8, band=-1)


@dataclass(frozen=True)
class BimeraParams:
    method: str = "consensus"
    min_fold: float = 1.5
    min_parent_abundance: int = 2
    allow_one_off: bool = False
    min_one_off_distance: int = 4
    max_shift: int = 16
    min_sample_fraction: float = 0.9
    ignore_negatives: int = 1
    trimera_min_gap: int = 15
    trimera_max_third: int = 15
    trimera_max_rate: float = 0.10
    trimera_min_nearest: int = 30


@dataclass(frozen=True)
class TaxonomyParams:
    min_boot: int = 50
    try_reverse: bool = False
    levels: tuple[str, ...] = LEVELS
    seed: int = 1


@dataclass(frozen=True)
class EvaluationParams:
    max_diffs: int = 0
    near_diffs: int = 3
    k: int = 5
    scoring: Scoring = Scoring(band=32)
