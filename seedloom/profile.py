"""Scan profiles: defaults, overrides, validation, statistics, TOML and option files.

A profile is a driver-side value object; it reaches executors only as literals or
as a few integers in a task closure.
"""

from __future__ import annotations

import dataclasses
import math
import os
import shlex
import tomllib
from dataclasses import dataclass

from .functions.alphabet import IUPAC_LETTERS, IUPAC_MASK

MIN_K, MAX_K = 3, 9
MAX_REF_LEN = 32767  # what the length filter takes for too long, unless told otherwise
POS_BITS = 28  # of a packed seed, for the place on the reference
LONGEST_REF = (1 << POS_BITS) - 1


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    k: int = 4
    window: int = 32
    min_seeds: int = 5
    span_threshold: int | None = None  # None: 2 * window; 0: flank filter off
    enable_filter: bool = True
    match: int = 2
    mismatch: int = 3
    ins_open: int = 5
    ins_extend: int = 1
    del_open: int = 5
    del_extend: int = 1
    max_gap_len: int = 16
    end_bonus: int = 10
    min_score: int = 30
    use_raw_score: bool = False
    max_amb_columns: int = 9
    name_pattern: str | None = None
    comment_pattern: str | None = None
    matrix: tuple | None = None  # ((query base, ref code), score) pairs, else match/mismatch

    def replace(self, **kw) -> Profile:
        if "gap_open" in kw:
            kw["ins_open"] = kw["del_open"] = kw.pop("gap_open")
        if "gap_extend" in kw:
            kw["ins_extend"] = kw["del_extend"] = kw.pop("gap_extend")
        return dataclasses.replace(self, **kw).validate()

    # ---- validation -------------------------------------------------------
    def validate(self) -> Profile:
        errors = []

        def need(ok, text):
            if not ok:
                errors.append(text)

        need(MIN_K <= self.k <= MAX_K, f"k must be between {MIN_K} and {MAX_K}")
        need(0 <= self.window <= 256, "window must be between 0 and 256")
        need(1 <= self.min_seeds <= 1024, "min_seeds must be between 1 and 1024")
        matches, mismatches = self._pair_scores()
        need(min(matches) >= 1 and max(matches) <= 31, "match must be between 1 and 31")
        need(min(mismatches) >= -31 and min(mismatches) <= -1, "mismatch must be between 1 and 31")
        for label in ("ins_open", "del_open"):
            need(0 <= getattr(self, label) <= 31, f"{label} must be between 0 and 31")
        for label in ("ins_extend", "del_extend"):
            need(1 <= getattr(self, label) <= 31, f"{label} must be between 1 and 31")
        need(1 <= self.max_gap_len <= 256, "max_gap_len must be between 1 and 256")
        need(0 <= self.end_bonus < 128, "end_bonus must be between 0 and 127")
        need(0 <= self.min_score < 2**31, "min_score must fit a positive 32-bit integer")
        if errors:
            raise ValueError("; ".join(errors))
        return self

    # ---- scores -----------------------------------------------------------
    def score(self, q: str, r: str) -> int:
        if self.matrix is not None:
            return dict(self.matrix)[(q, r)]
        return self.match if IUPAC_MASK[q] & IUPAC_MASK[r] else -self.mismatch

    def _pair_scores(self) -> tuple[list[int], list[int]]:
        hit, miss = [], []
        for q in "ACGT":
            for r in IUPAC_LETTERS:
                (hit if IUPAC_MASK[q] & IUPAC_MASK[r] else miss).append(self.score(q, r))
        return hit, miss

    def score_table(self) -> list[list[int]]:
        """4 rows (query ACGT) x reference IUPAC letters."""
        return [[self.score(q, r) for r in IUPAC_LETTERS] for q in "ACGT"]

    # ---- derived parameters -------------------------------------------------
    @property
    def squash_interval(self) -> int:
        """Half of the largest power of two not above the window, at least one."""
        return max(1, (1 << (self.window.bit_length() - 1)) // 2) if self.window else 1

    @property
    def xdrop(self) -> int:
        return max(self.ins_open, self.del_open) + max(self.ins_extend, self.del_extend) * self.max_gap_len

    @property
    def filter_span(self) -> int | None:
        """Chains with a query span above this skip the flank filter; None filters nothing."""
        if not self.enable_filter:
            return None
        return 2 * self.window if self.span_threshold is None else self.span_threshold

    def statistics(self) -> dict[str, float]:
        """Karlin-Altschul style statistics with uniform base frequencies."""
        rows = [[self.score(q, r) for r in "ACGT"] for q in "ACGT"]
        flat = [s for row in rows for s in row]
        p = 1.0 / 16.0
        lo, hi = 0.0, 2.0
        while hi - lo > 1e-5:
            mid = (lo + hi) / 2.0
            if sum(p * math.exp(mid * s) for s in flat) > 1.0:
                hi = mid
            else:
                lo = mid
        lam = (lo + hi) / 2.0
        weight = [p * math.exp(lam * s) for s in flat]
        return {
            "lambda": lam,
            "expected_score": sum(p * s for s in flat),
            "identity": sum(w for w, s in zip(weight, flat) if s > 0),
            "relative_entropy": lam * sum(w * s for w, s in zip(weight, flat)),
        }

    @property
    def rlambda(self) -> float:
        return 1.0 / self.statistics()["lambda"]

    def flank_scores(self) -> dict[str, int]:
        """Match, mismatch, gap and threshold of the cheap flank filter."""
        hit, miss = self._pair_scores()

        def pick(values, extreme, clip):
            ave = int(sum(values) / len(values))
            return extreme(values) if extreme(values) == ave else clip(int(ave * 3 / 4))

        m = pick(hit, min, lambda a: max(1, a))
        x = pick(miss, max, lambda a: min(-1, a))
        gap = -((self.ins_open + self.del_open) // 8 + (self.ins_extend + self.del_extend) // 2)
        ident = self.statistics()["identity"] * 0.85
        threshold = max(0, int(16.0 * (m * ident + x * (1.0 - ident))))
        return {"match": m, "mismatch": x, "gap": gap, "min_score": threshold}


DEFAULT_PROFILE = Profile().validate()

# Profile keys of a TOML table and the letters an abbreviation needs at least.
TOML_KEYS = {
    "kmer_size": ("k", 4),
    "window_size": ("window", 6),
    "min_seed_cnt": ("min_seeds", 8),
    "enable_filter": ("enable_filter", 6),
    "gap_max_len": ("max_gap_len", 7),
    "ins_open": ("ins_open", 6),
    "ins_extend": ("ins_extend", 6),
    "del_open": ("del_open", 6),
    "del_extend": ("del_extend", 6),
    "min_score": ("min_score", 6),
    "score_matrix": ("matrix", 5),
    "name": ("name_pattern", 4),
    "comment": ("comment_pattern", 7),
}


def _toml_field(key: str) -> str:
    for full, (attr, shortest) in TOML_KEYS.items():
        if len(key) >= shortest and full.startswith(key):
            return attr
    raise ValueError(f"unknown profile key: {key}")


def _matrix_from_rows(rows: list) -> tuple:
    header, body = [str(x).upper() for x in rows[0]], rows[1:]
    if len(body) != 4 or len(header) not in (4, len(IUPAC_LETTERS)):
        raise ValueError("score_matrix needs a header row and four rows of scores")
    plain = {}
    for q, row in zip("ACGT", body):
        if len(row) != len(header):
            raise ValueError("score_matrix rows must be as long as the header")
        plain.update({(q, r): int(s) for r, s in zip(header, row)})
    out = {}
    for q in "ACGT":
        for r in IUPAC_LETTERS:
            # a code that is not listed scores as the best base it can stand for
            inside = [plain[(q, b)] for b in "ACGT" if IUPAC_MASK[b] & IUPAC_MASK[r]]
            out[(q, r)] = plain.get((q, r), max(inside))
    return tuple(sorted(out.items()))


def profiles_from_toml(path: str, base: Profile = DEFAULT_PROFILE) -> list[Profile]:
    """Profiles of a TOML file in file order, followed by the fallback profile."""
    with open(path, "rb") as fp:
        doc = tomllib.load(fp)
    out = []
    for table, body in doc.items():
        if not isinstance(body, dict):
            raise ValueError(f"expected a table: {table}")
        kw = {}
        for key, value in body.items():
            attr = _toml_field(key)
            kw[attr] = _matrix_from_rows(value) if attr == "matrix" else value
        if "name_pattern" not in kw and "comment_pattern" not in kw:
            continue
        out.append(dataclasses.replace(base, name=table, **kw).validate())
    return [*out, base]


# One-letter options and the keyword each stands for; without a type a switch.
OPTIONS = {
    "-k": ("k", int), "-w": ("window", int), "-c": ("min_seeds", int),
    "-S": ("span_threshold", int), "-a": ("match", int), "-b": ("mismatch", int),
    "-p": ("gap_open", int), "-q": ("gap_extend", int), "-m": ("min_score", int),
    "-g": ("max_gap_len", int), "-l": ("end_bonus", int), "-R": ("use_raw_score", None),
}
# Those of a run that are no part of a profile.
RUN_OPTIONS = {
    "-x": ("preset", str), "-z": ("profiles", str), "-d": ("index_path", str), "-F": ("alignments", str),
    "-G": ("patch_gap", int), "-M": ("patch_margin", int), "-L": ("lenient", None),
}


@dataclass(frozen=True)
class RunOptions:
    """What a list of options says: profile keywords, the other options, and words that belong to none."""

    profile: dict[str, int | bool]
    run: dict[str, str | int | bool]
    words: tuple[str, ...] = ()

    def over(self, base: RunOptions) -> RunOptions:
        """These options after those of ``base``: of an option given twice the later one counts."""
        return RunOptions({**base.profile, **self.profile}, {**base.run, **self.run}, base.words + self.words)


NO_OPTIONS = RunOptions({}, {})


def _is_value(word: str) -> bool:
    """Whether a word can be an option's value: it is no option itself; ``-`` and negative numbers are none."""
    return not word.startswith("-") or word == "-" or word[1:2].isdigit()


def parse_options(args: list[str], opened: tuple[str, ...] = ()) -> RunOptions:
    """Options in their order: ``-k 5``, ``-k5``, and switches run together as in ``-RLk5``.

    ``-x FILE`` stands for the options in the file, at its place; a file may name others,
    relative paths being those of the file that names them.  ``opened`` are the files being read: one that
    leads back to itself is an error.
    """
    found = NO_OPTIONS
    words = list(reversed(args))
    while words:
        word = words.pop()
        if _is_value(word):
            found = RunOptions({}, {}, (word,)).over(found)
            continue
        rest = word[1:]
        while rest:
            flag, rest = f"-{rest[0]}", rest[1:]
            kind = OPTIONS.get(flag) or RUN_OPTIONS.get(flag)
            if kind is None:
                raise ValueError(f"unknown option {flag} in {word}")
            name, conv = kind
            if conv is None:
                value = True
            else:
                text = rest or (words.pop() if words and _is_value(words[-1]) else None)
                rest = ""
                if text is None:
                    raise ValueError(f"option {flag} needs a value")
                try:
                    value = conv(text)
                except ValueError:
                    raise ValueError(f"option {flag} takes a number, not {text}") from None
            if flag == "-x":
                found = options_of_file(value, opened).over(found)
            else:
                one = {name: value}
                found = (RunOptions(one, {}) if flag in OPTIONS else RunOptions({}, one)).over(found)
    return found


def options_of_file(path: str, opened: tuple[str, ...] = ()) -> RunOptions:
    """Options kept in a file; line breaks and tabs separate like spaces, ``#`` opens a remark."""
    if opened:
        path = os.path.join(os.path.dirname(opened[-1]), path)
    real = os.path.realpath(path)
    if real in opened:
        raise ValueError(f"option files that name each other: {' -> '.join([*opened, real])}")
    with open(real) as fp:
        return parse_options(shlex.split(fp.read(), comments=True), (*opened, real))


def profile_of(options: RunOptions, base: Profile = DEFAULT_PROFILE) -> Profile:
    return base.replace(**options.profile)


def profile_from_options(args: list[str], base: Profile = DEFAULT_PROFILE) -> Profile:
    return profile_of(parse_options(args), base)


def profile_from_file(path: str, base: Profile = DEFAULT_PROFILE) -> Profile:
    return profile_of(options_of_file(path), base)
