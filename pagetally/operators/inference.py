"""Sequence inference that has no closed form, in plain Python over one row per file.

A file's pages are gathered into sorted arrays (they are bounded by the file), on the partitioning that the
page relation already has, so no shuffle is added; files come in Arrow batches, not one call each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass, fields, replace
from itertools import accumulate, product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The strongest lag must stand out by this, up to this many pages, with so many pages read.
AUTOCORRELATION_MIN = 0.3
MOST_LAG = 50
LEAST_READ = 6
#: What starts, declared totals and autocorrelation weigh for a file's period.
PERIOD_WEIGHTS = (0.45, 0.30, 0.25)


@dataclass(frozen=True)
class Rules:
    """What inference weighs. `PRODUCTION` and the values to try are those of the parameter sweeps."""

    #: pages on either side of a page, and their agreement for a local total
    window: int = 5
    agreement: float = 0.85
    #: a gap's cost: a total unlike those around, a start unlike the file's, a clash at its border (more in long gaps)
    off_total: float = 0.75
    off_period: float = 2.5
    clash: float = 1.5
    zone: int = 0
    zone_scale: float = 1.0
    #: how sure a page is that goes on forwards, starts a document (and what the agreement around adds), or goes backwards
    forward: float = 0.99
    start: float = 0.60
    start_agreement: float = 0.30
    backward: float = 0.85
    #: the most for a page that fits no neighbour; what other cycles, neighbours and usual totals add, and the most of it
    unfit: float = 0.50
    by_period: float = 0.10
    by_neighbour: float = 0.10
    by_prior: float = 0.07
    most_added: float = 0.18
    #: the least period and share of totals to overrule a read, and the least of an inferred start
    least_period: float = 0.50
    least_share: float = 0.90
    least_start: float = 0.55
    #: where over 0: reads of a one-page total in a file of longer ones that come below it are dropped; how sure a last resort is
    dropout: float = 0.0
    last_resort: float = 0.0
    #: starts closer than this cannot both stand (1: any may)
    least_gap: int = 1


#: The rules that a sweep settled on, and what it tried for each.
PRODUCTION = Rules(window=9, agreement=0.80, off_total=1.5, off_period=3.0, clash=1.0, zone=10, zone_scale=3.0, forward=1.0, start=0.60, start_agreement=0.28, backward=0.85, unfit=0.40, by_period=0.10, by_neighbour=0.08, by_prior=0.05, most_added=0.18, least_period=0.65, least_share=0.90, least_start=0.55, dropout=0.10, last_resort=0.10, least_gap=2)
SPACE = {
    "forward": (0.97, 0.99, 1.00), "start": (0.60, 0.65, 0.68, 0.70), "start_agreement": (0.25, 0.28, 0.30, 0.33), "backward": (0.85, 0.88, 0.90), "unfit": (0.40, 0.43, 0.45, 0.48, 0.50),
    "by_period": (0.10, 0.12, 0.14), "by_neighbour": (0.08, 0.10, 0.12), "by_prior": (0.05, 0.07, 0.09), "most_added": (0.18, 0.20, 0.22), "least_period": (0.50, 0.55, 0.60, 0.65), "least_share": (0.90, 0.93, 0.95),
    "least_start": (0.55, 0.60, 0.65, 0.70), "dropout": (0.0, 0.10, 0.20, 0.30), "off_total": (0.75, 1.0, 1.5, 2.0), "off_period": (1.5, 2.0, 2.5, 3.0), "last_resort": (0.0, 0.10, 0.15), "clash": (1.0, 1.5, 2.0, 3.0),
    "zone_scale": (1.0, 1.5, 2.0, 3.0), "zone": (5, 10, 20, 50), "window": (5, 7, 9), "agreement": (0.80, 0.83, 0.85), "least_gap": (1, 2),
}


def gathered(df: DataFrame, names: list[str], *more) -> DataFrame:
    """A row per file: its id, its columns as arrays sorted by the first, and more aggregates."""
    files = df.groupBy("pdf").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("p"), *more)
    return files.select("pdf", *(F.col(f"p.{n}").alias(n) for n in names), *files.columns[2:])


def solved(files: DataFrame, solve: Callable[[Iterable[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """`solve` takes the rows of some files, a batch at a time, and gives rows."""
    made = T.StructType.fromDDL(ddl)
    out = to_arrow_schema(made)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if found := list(solve(zip(*(c.to_pylist() for c in b.columns), strict=True))):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    return files.mapInArrow(rows, made)


def per_file(df: DataFrame, names: list[str], solve: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """`solve` takes a file's columns, sorted by the first, and gives rows; the file's id is put before each."""
    return solved(gathered(df, names), lambda files: ((pdf, *r) for pdf, *own in files for r in solve(*own)), ddl)


def autocorrelation_period(curr: np.ndarray) -> tuple[int | None, float]:
    """First lag whose normalised autocorrelation is a local maximum over the minimum."""
    known = np.flatnonzero(~np.isnan(curr))
    n = len(curr)
    if n < 4 or len(known) < LEAST_READ:
        return None, 0.0
    x = np.interp(np.arange(n), known, curr[known])
    x = x - x.mean()
    power = float((x * x).sum())
    if power == 0:
        return None, 0.0
    top = min(n // 2, MOST_LAG)
    r = [1.0, *(float((x[k:] * x[:-k]).sum()) / power for k in range(1, top + 1))]
    for k in range(2, top):
        if r[k] > AUTOCORRELATION_MIN and r[k] > r[k - 1] and r[k] >= r[k + 1]:
            return k, r[k]
    return None, 0.0


def _mode(values: Sequence) -> tuple[object, float]:
    """The most frequent value, the first seen of equals, and its share."""
    if not values:
        return None, 0.0
    times = Counter(values)
    value = max(times, key=times.get)
    return value, times[value] / len(values)


def _numbers(curr: Sequence[int | None]) -> np.ndarray:
    return np.array([np.nan if c is None else c for c in curr], float)


def file_period(curr: Sequence[int | None], total: Sequence[int | None]) -> tuple[int | None, float, int | None]:
    """A file's period, how sure it is, and the total to expect, from three weighted votes."""
    known = [i for i, c in enumerate(curr) if c is not None]
    if len(curr) < 4 or len(known) < 3:
        return None, 0.0, None
    starts = [i for i in known if curr[i] == 1]
    usual = _mode([total[i] for i in known if total[i] is not None])
    votes: dict[int, float] = {}
    for (period, share), weight in zip((_mode([b - a for a, b in zip(starts, starts[1:])]), usual, autocorrelation_period(_numbers(curr))), PERIOD_WEIGHTS, strict=True):  # noqa: B905, RUF007
        if period is not None and share > 0.3:
            votes[period] = votes.get(period, 0.0) + share * weight
    if not votes:
        return None, 0.0, usual[0]
    best = max(votes, key=votes.get)
    return best, min(votes[best], 1.0), usual[0] or best


Page = tuple[int | None, int | None]  # its number and its document's total


def _known(page: Page | None) -> bool:
    return page is not None and None not in page


def follows(a: Page, b: Page) -> bool:
    """Whether b may come right after a: the same document goes on, or a ends one and b starts the next."""
    return (a[1] == b[1] and b[0] == a[0] + 1) or (a[0] == a[1] and b[0] == 1)


def _after(page: Page | None, usual: int) -> Page:
    return (page[0] + 1, page[1]) if _known(page) and page[0] < page[1] else (1, usual)


def _before(page: Page | None, usual: int) -> Page:
    return (page[0] - 1, page[1]) if _known(page) and page[0] > 1 else (usual, usual)


#: Kinds of pages whose numbers are known.
READ = ("direct", "manual")


@dataclass
class Ways:
    """A run of unread pages filled from the left and from the right. What each costs: weights with the rules that they are
    multiplied by, and whether it clashes at its border."""

    a: int
    b: int
    made: tuple[list[Page], list[Page]]
    terms: tuple[list[tuple[float, str]], list[tuple[float, str]]]
    clashes: tuple[bool, bool]

    def __post_init__(self):
        start = [any(n == 1 for n, _ in made) for made in self.made]
        self.on_tie = start[1] and not start[0]
        self.alike = self.terms[0] == self.terms[1] and self.clashes[0] == self.clashes[1]

    def backward(self, rules: Rules) -> bool:
        """Whether the right one is cheaper; on a tie, the one with a start."""
        if self.alike:
            return self.on_tie
        left, right = self._costs(rules, rules.clash * (rules.zone_scale if self.b - self.a >= rules.zone else 1.0))
        return right < left or (right == left and self.on_tie)

    def backwards(self, rules: Rules | Columns) -> np.ndarray | bool:
        """The same under each of many rules, or under all of them."""
        if self.alike or isinstance(rules, Rules):
            return self.backward(rules)
        left, right = self._costs(rules, np.where(self.b - self.a >= rules.zone, rules.clash * rules.zone_scale, rules.clash))
        return right <= left if self.on_tie else right < left

    def _costs(self, rules: Rules | Columns, clash: float | np.ndarray) -> list:
        costs = []
        for terms, clashes in zip(self.terms, self.clashes, strict=True):
            cost = 0.0
            for weight, rule in terms:
                cost = cost + weight * getattr(rules, rule)
            costs.append(cost + clash * clashes)
        return costs


def supported(sure: float, support: float, agree: int, prior: float, rules: Rules) -> float:
    """How sure an inferred page is with what other cycles, its neighbours and usual totals add."""
    if support > 0.2 or agree == 2:
        added = support * rules.by_period + agree * rules.by_neighbour + prior * rules.by_prior
        return min(sure + min(added, rules.most_added), 0.75)
    return sure


class Inference:
    """One file's pages. `fill` solves runs of unread pages; `settle` weighs and corrects what was inferred."""

    def __init__(self, curr: Sequence[int | None], total: Sequence[int | None], rules: Rules = Rules(), kinds: Sequence[str] | None = None, period: tuple | None = None):
        """kinds: of each page `direct` or `manual` (as sure as can be), `failed` or `excluded`; by default as read or not.
        period: `file_period`, where it is known."""
        self.rules = rules
        self.pages: list[Page] = list(zip(curr, total, strict=True))
        self.kinds = list(kinds) if kinds else ["failed" if c is None else "direct" for c in curr]
        self.sure = [0.0 if k == "failed" else 1.0 for k in self.kinds]
        self.period, self.period_sure, self.expected = period or file_period(curr, total)
        seen = Counter(t for t in total if t is not None)
        self.prior = {t: n / seen.total() for t, n in seen.items()} or {2: 0.85, 3: 0.10, 1: 0.05}
        self.usual = max(self.prior, key=self.prior.get)
        #: Totals as they are read now, and their modes around pages; all such of this file, by the window and the totals.
        self._near: tuple[tuple[int | None, ...], dict[int, tuple[int | None, float]]] | None = None
        self._all_near: dict[tuple, tuple] = {}

    def under(self, rules: Rules) -> Inference:
        """The same pages under other rules."""
        x = copy(self)
        x.rules, x.pages, x.kinds, x.sure, x._near = rules, list(self.pages), list(self.kinds), list(self.sure), None
        return x

    def local(self, i: int) -> tuple[int, float]:
        """The total around a page if enough reads agree, else the file's, and the agreement."""
        if self._near is None:
            read = self._totals()
            self._near = self._all_near.setdefault((self.rules.window, read), (read, {}))
        read, near = self._near
        if i not in near:
            own = [t for t in read[max(0, i - self.rules.window) : i + self.rules.window + 1] if t is not None]
            total = max(dict.fromkeys(own), key=own.count, default=None)  # the first seen of equals
            near[i] = total, own.count(total) / len(own) if own else 0.0
        total, share = near[i]
        return total if total is not None and share >= self.rules.agreement else self.usual, share

    def _totals(self) -> tuple[int | None, ...]:
        return tuple([t if k in READ else None for (_, t), k in zip(self.pages, self.kinds, strict=True)])

    def gaps(self) -> list[tuple[int, int]]:
        found, start = [], None
        for i, k in enumerate([*self.kinds, None]):
            if k == "failed":
                start = i if start is None else start
            elif start is not None:
                found.append((start, i))
                start = None
        return found

    def _terms(self, made: list[Page], around: list[tuple[int, float]]) -> list[tuple[float, str]]:
        terms = []
        for (number, total), (usual, share) in zip(made, around, strict=True):
            if total != usual:
                terms.append((share, "off_total"))
            if number == 1 and self.period and self.period_sure > 0.3 and total != self.expected:
                terms.append((self.period_sure, "off_period"))
        return terms

    def ways(self, a: int, b: int) -> Ways:
        """A run's two ways. The pages at its borders are not unread, so other runs do not matter."""
        around = [self.local(i) for i in range(a, b)]
        usuals = [u for u, _ in around]
        left, right = self.pages[a - 1] if a else None, self.pages[b] if b < len(self.pages) else None
        onward = list(accumulate(usuals, _after, initial=left if _known(left) else (None, None)))[1:]
        if right is not None and right[0] == 1:
            onward[-1] = (onward[-1][0], onward[-1][0])
        back = list(accumulate(reversed(usuals), _before, initial=right if _known(right) else (None, None)))[:0:-1]
        clashes = (_known(right) and not follows(onward[-1], right), _known(left) and not follows(left, back[0]))
        return Ways(a, b, (onward, back), (self._terms(onward, around), self._terms(back, around)), clashes)

    def fill(self) -> Inference:
        """Each run is filled from the left and from the right; the cheaper one stays, on a tie the one with a start."""
        for a, b in self.gaps():
            ways = self.ways(a, b)
            backward = ways.backward(self.rules)
            self.pages[a:b] = ways.made[backward]
            self.kinds[a:b] = ["inferred"] * (b - a)
            self.sure[a:b] = [self.rules.backward if backward else self._start(self.local(i)[1]) if self.pages[i][0] == 1 else self.rules.forward for i in range(a, b)]
        return self

    def _start(self, share: float) -> float:
        return self.rules.start + share * self.rules.start_agreement

    def drop_odd(self) -> Inference:
        """Where the rules ask for it: reads that declare one page among longer documents lose what the pages around
        agree by, and are unread if too little is left."""
        if self.rules.dropout > 0:
            for i, (_, total) in enumerate(self.pages):
                if self.kinds[i] in READ and total == 1:
                    usual, share = self.local(i)
                    if share >= self.rules.agreement and usual > 1:
                        self.sure[i] -= share
                        if self.sure[i] < self.rules.dropout:
                            self.kinds[i], self.pages[i], self._near = "failed", (None, None), None
        return self

    def last_resort(self) -> Inference:
        """Where the rules ask for it: pages that are still unread start a document of the usual total."""
        if self.rules.last_resort > 0:
            for i, k in enumerate(self.kinds):
                if k == "failed":
                    self.pages[i], self.kinds[i], self.sure[i] = (1, self.local(i)[0]), "inferred", self.rules.last_resort
        return self

    def part_starts(self) -> Inference:
        """Where the rules ask for it, and the file's period is clear and long enough: of two starts that are too close
        the earlier goes, or the later if it fits the period less well, counted from the start before them."""
        gap, period = self.rules.least_gap, self.period
        if gap <= 1 or period is None or period < 2 * gap or self.period_sure < 0.4:
            return self
        off = lambda x, base: min((x - base) % period, -(x - base) % period)
        kept: list[int] = []
        at = None  # the last start, which may still go
        for i in (i for i, (n, _) in enumerate(self.pages) if n == 1):
            if at is not None and i - at < gap:
                if kept and off(at, kept[-1]) < off(i, kept[-1]):
                    self._exclude(i)
                    kept.append(at)
                    at = None
                    continue
                self._exclude(at)
            elif at is not None:
                kept.append(at)
            at = i
        return self

    def _exclude(self, i: int) -> None:
        self.kinds[i], self.pages[i], self._near = "excluded", (None, None), None

    def _links(self, i: int) -> list[bool]:
        """Whether a page fits each neighbour that has a number and a total."""
        p, near = self.pages, []
        if i and _known(p[i - 1]):
            near.append(follows(p[i - 1], p[i]))
        if i + 1 < len(p) and _known(p[i + 1]):
            near.append(follows(p[i], p[i + 1]))
        return near

    def evidence(self, i: int) -> dict[Page, float]:
        """Pages at the same place in other cycles, nearer and read ones weighing more; the weights sum to 1."""
        found: dict[Page, float] = {}
        for k, side in product(range(1, 8), (-1, 1)):
            j = i + side * k * self.period
            if 0 <= j < len(self.pages) and self.pages[j][0] is not None:
                found[self.pages[j]] = found.get(self.pages[j], 0.0) + (1.0 if self.kinds[j] in READ else 0.5) / k
        whole = sum(found.values())
        return {page: w / whole for page, w in found.items()}

    def doubtful(self) -> list[int]:
        """Inferred starts that another start follows at once."""
        return [i for i, k in enumerate(self.kinds[:-1]) if k == "inferred" and self.pages[i][0] == 1 and self.pages[i + 1][0] == 1]

    def cap(self) -> Inference:
        """Inferred pages that do not fit a neighbour are less sure."""
        for i, k in enumerate(self.kinds):
            if k == "inferred" and not all(self._links(i)):
                self.sure[i] = min(self.sure[i], self.rules.unfit)
        return self

    def settle(self) -> Inference:
        doubtful = self.doubtful()
        self.cap().last_resort()
        inferred = [i for i, k in enumerate(self.kinds) if k == "inferred"]
        if self.period is not None and self.period_sure > 0.3:
            for i in (i for i in inferred if self.sure[i] <= 0.60):
                self.sure[i] = supported(self.sure[i], self.evidence(i).get(self.pages[i], 0.0) * self.period_sure, sum(self._links(i)), self.prior.get(self.pages[i][1], 0.0), self.rules)
        agreed, wrong = self.contradicting()
        if self.overruled(agreed, self.rules):
            self.overrule(wrong)
        for i in doubtful:
            if self.kinds[i] == "inferred" and self.pages[i][0] == 1 and self.sure[i] < self.rules.least_start:
                self._exclude(i)
        return self

    def contradicting(self) -> tuple[float, list[int]]:
        """The share of reads that declare the expected total (0 without any), and those that declare another."""
        read = [i for i, k in enumerate(self.kinds) if k in READ and self.pages[i][1] is not None]
        wrong = [i for i in read if self.pages[i][1] != self.expected]
        return (len(read) - len(wrong)) / len(read) if read else 0.0, wrong

    def overruled(self, agreed: float, rules: Rules) -> bool:
        """Whether a file's period is clear enough, and enough reads agree, to overrule the others."""
        return self.period is not None and self.period_sure >= rules.least_period and self.expected is not None and agreed >= rules.least_share

    def overrule(self, wrong: list[int]) -> None:
        """Reads that declare another total get the expected one, and the inferred pages after them go on from there."""
        expected = self.expected
        inferred = [i for i, k in enumerate(self.kinds) if k == "inferred" and self.local(i)]  # by the totals around as they were read
        near = {i: self._near[1][i] for i in inferred}
        for i in wrong:
            number = self.pages[i][0]
            self.pages[i] = (number if number is not None and 1 <= number <= expected else 1, expected)
            self.kinds[i], self.sure[i] = "inferred", 0.50
        self._near = self._totals(), near
        for i in wrong:
            for j in range(i + 1, len(self.pages)):
                last = self.pages[j - 1]
                if self.kinds[j] != "inferred" or not _known(last) or last[0] > last[1]:
                    break
                self.pages[j] = _after(last, expected)
                if last[0] == last[1]:
                    self.sure[j] = self._start(self.local(j)[1])


#: Many rules, an array for each of their names.
Columns = SimpleNamespace
_NAMES = tuple(f.name for f in fields(Rules))
#: What the first steps of a replay depend on, each on its own rules and on those before it; the later ones take rules as columns.
_STEPS = (("least_gap",), ("window", "agreement"), ("dropout",))


@dataclass
class Steps:
    """Numbered rules: as a tree by the first steps (those alike in a step's rules are one branch, with any of them, and the
    places of those at its end), and as columns."""

    numbers: list[int]
    rules: list[Rules]
    tree: list
    values: np.ndarray

    def at(self, places: np.ndarray) -> Rules | Columns:
        if len(places) == 1:
            return self.rules[places[0]]
        return Columns(**dict(zip(_NAMES, self.values[:, places], strict=True)))


def stepwise(rules: Iterable[tuple[int, Rules]]) -> Steps:
    numbers, rules = map(list, zip(*rules, strict=True))

    def branches(own: list[int], steps: Sequence[tuple[str, ...]]) -> list | np.ndarray:
        if not steps:
            return np.array(own)
        parts: dict[tuple, list[int]] = {}
        for k in own:
            parts.setdefault(tuple(getattr(rules[k], n) for n in steps[0]), []).append(k)
        return [(rules[own[0]], branches(own, steps[1:])) for _, own in sorted(parts.items(), reverse=True)]

    return Steps(numbers, rules, branches(list(range(len(rules))), _STEPS), np.array([[getattr(r, n) for r in rules] for n in _NAMES], float))


def _parted(groups: list[tuple[tuple[bool, ...], np.ndarray]], marks: np.ndarray | bool) -> list[tuple[tuple[bool, ...], np.ndarray]]:
    """Groups of places, with the marks they have in common, by one mark more."""
    if isinstance(marks, bool):
        return [((*own, marks), at) for own, at in groups]
    found = []
    for own, at in groups:
        marked = marks[at]
        n = int(np.count_nonzero(marked))
        if 0 < n < len(at):
            found += [((*own, True), at[marked]), ((*own, False), at[~marked])]
        else:
            found.append(((*own, n > 0), at))
    return found


class _Filled:
    """A file whose unread pages are filled in one way, and what settling it depends on."""

    def __init__(self, before: Inference, ways: list[Ways], backward: Sequence[bool]):
        self.x = x = before.under(before.rules)
        self.backward: dict[int, bool] = {}
        for w, back in zip(ways, backward, strict=True):
            x.pages[w.a : w.b], x.kinds[w.a : w.b] = w.made[back], ["inferred"] * (w.b - w.a)
            self.backward |= dict.fromkeys(range(w.a, w.b), back)
        self.agreed, self.wrong = x.contradicting()
        self.doubtful = [(i, before.local(i)[1], x._links(i), x.prior.get(x.pages[i][1], 0.0)) for i in x.doubtful()]
        self._support: dict[int, float] = {}
        self._over: Inference | None = None

    def overruled(self, rules: Rules | Columns) -> np.ndarray | bool:
        x = self.x
        if not self.wrong or x.period is None or x.expected is None:
            return False
        return (x.period_sure >= rules.least_period) & (self.agreed >= rules.least_share)

    def pages(self, overruled: bool) -> Inference:
        """Overruled or not; where overruling says anew how sure a page is, it is not None."""
        if not overruled:
            return self.x
        if self._over is None:
            self._over = self.x.under(self.x.rules)
            self._over.sure = [None] * len(self.x.pages)
            self._over.overrule(self.wrong)
        return self._over

    def support(self, i: int) -> float:
        if i not in self._support:
            self._support[i] = self.x.evidence(i).get(self.x.pages[i], 0.0) * self.x.period_sure
        return self._support[i]

    def unsure(self, overruled: bool, rules: Rules | Columns) -> Iterator[tuple[int, np.ndarray | bool]]:
        """The doubtful starts, and under which rules they are excluded; no other page's result depends on how sure it is."""
        x = self.pages(overruled)
        least, where = (min, lambda is_so, a, b: a if is_so else b) if isinstance(rules, Rules) else (np.minimum, np.where)
        for i, share, links, prior in self.doubtful:
            if x.pages[i][0] != 1:
                continue
            sure = rules.start + share * rules.start_agreement
            if not (overruled and x.sure[i] is not None):
                sure = rules.backward if self.backward[i] else sure
                if not all(links):
                    sure = least(sure, rules.unfit)
                support, agree = self.support(i) if x.period is not None else 0.0, sum(links)
                if x.period is not None and x.period_sure > 0.3 and (support > 0.2 or agree == 2):
                    added = support * rules.by_period + agree * rules.by_neighbour + prior * rules.by_prior
                    sure = where(sure <= 0.60, least(sure + least(added, rules.most_added), 0.75), sure)
            yield i, sure < rules.least_start


def replayed(curr: Sequence[int | None], total: Sequence[int | None], steps: Steps, period: tuple | None = None) -> Iterator[tuple[list[Page], list[str], list[int]]]:
    """A file's pages and their kinds after all of inference, with the numbers of the rules that give them.
    A step is done once for all rules that are alike in what it depends on, or that come to the same before it."""
    first, seen, before = Inference(curr, total, period=period), {}, {}
    for rules, branches in steps.tree:
        parted = first.under(rules).part_starts()
        kinds = tuple(parted.kinds)
        for _, branches in branches:  # noqa: B020, PLW2901
            dropped = True
            for rules, own in branches:  # noqa: PLW2901 - the largest dropout first: where it drops nothing, no other does
                if dropped:
                    at = (kinds, rules.window, rules.agreement, rules.dropout)
                    if at not in seen:
                        x = parted.under(rules).drop_odd()
                        gaps = x.gaps()
                        key = (tuple(x.kinds), tuple([x.local(i) for a, b in gaps for i in range(a, b)]))
                        seen[at] = key[0] != kinds, before.setdefault(key, (x, gaps, []))[2]
                    dropped, alike = seen[at]
                alike.append(own)
    for x, gaps, alike in before.values():
        places = np.concatenate(alike)
        rules, ways = steps.at(places), [x.ways(a, b) for a, b in gaps]
        groups = [((), np.arange(len(places)))]
        for w in ways:
            groups = _parted(groups, w.backwards(rules))
        for backward, at in groups:
            filled = _Filled(x, ways, backward)
            for (overruled,), at in _parted([((), at)], filled.overruled(rules)):  # noqa: B020, PLW2901
                settled, doubtful = [((), at)], []
                for i, unsure in filled.unsure(overruled, rules):
                    settled = _parted(settled, unsure)
                    doubtful.append(i)
                done = filled.pages(overruled)
                for unsure, at in settled:  # noqa: PLW2901
                    pages, kinds = list(done.pages), list(done.kinds)
                    for i in (i for i, out in zip(doubtful, unsure, strict=True) if out):
                        pages[i], kinds[i] = (None, None), "excluded"
                    yield pages, kinds, [steps.numbers[k] for k in places[at].tolist()]


def w07_autocorrelation(s) -> DataFrame:
    def solve(page, curr):
        period, strength = autocorrelation_period(_numbers(curr))
        return [(period, round(strength, 9))]

    return per_file(s["page_reads"], ["page", "curr"], solve, "pdf bigint, period int, strength double")


def w08_file_period(s) -> DataFrame:
    def solve(page, curr, total):
        period, sure, expected = file_period(curr, total)
        return [(period, round(sure, 9), expected)]

    return per_file(s["page_reads"], ["page", "curr", "total"], solve, "pdf bigint, period int, confidence double, expected_total int")


_PAGES = "pdf bigint, page int, curr int, total int, method string, confidence double"


def _paged(x: Inference, page: Sequence[int]) -> list[tuple]:
    return [(p, *x.pages[i], x.kinds[i], round(x.sure[i], 9)) for i, p in enumerate(page)]


def filled(s) -> DataFrame:
    """Every page, with the runs of unread ones solved."""
    return per_file(s["page_reads"], ["page", "curr", "total"], lambda page, curr, total: _paged(Inference(curr, total).fill(), page), _PAGES)


def inferred(s) -> DataFrame:
    """Every page after all of inference: gaps, neighbours, evidence, contradictions, suppressed starts."""
    return per_file(s["page_reads"], ["page", "curr", "total"], lambda page, curr, total: _paged(Inference(curr, total).fill().settle(), page), _PAGES)


def w11_gap_solver(s) -> DataFrame:
    return s["filled"]


def w16_inference(s) -> DataFrame:
    return s["inferred"]


def w12_orphan_candidates(s) -> DataFrame:
    return s.sql("SELECT pdf, page FROM (SELECT *, lead(curr) OVER (PARTITION BY pdf ORDER BY page) AS next_curr FROM {filled}) AS f WHERE method = 'inferred' AND curr = 1 AND next_curr = 1")


def w13_cross_validation(s) -> DataFrame:
    """Inferred pages that do not follow the page before, or do not lead to the next, are at most half sure."""
    fits = "(({a}_total = {b}_total AND {b}_curr = {a}_curr + 1) OR ({a}_curr = {a}_total AND {b}_curr = 1))"
    left, right = fits.format(a="prev", b="own"), fits.format(a="own", b="next")
    near = ", ".join(f"{f}({c}) OVER (PARTITION BY pdf ORDER BY page) AS {n}_{c}" for f, n in (("lag", "prev"), ("lead", "next")) for c in ("curr", "total"))
    return s.sql(f"SELECT pdf, page, CASE WHEN method = 'inferred' AND NOT (COALESCE({left}, true) AND COALESCE({right}, true)) THEN least(confidence, 0.5D) ELSE confidence END AS confidence FROM (SELECT *, curr AS own_curr, total AS own_total, {near} FROM {{filled}}) AS f")


#: Each page with the totals read around it (a window's worth of pages on either side), and its file's usual total.
_AROUND = """
    SELECT *, collect_list(total) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near,
      COALESCE(first_value(total) OVER (PARTITION BY pdf ORDER BY CASE WHEN total IS NULL THEN 1 ELSE -times END, seen ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 2) AS usual
    FROM (SELECT *, count(*) OVER (PARTITION BY pdf, total) AS times, min(page) OVER (PARTITION BY pdf, total) AS seen FROM {page_reads}) AS r"""
_MODE = "aggregate(array_distinct(near), named_struct('total', CAST(NULL AS INT), 'n', 0), (a, t) -> IF(size(filter(near, x -> x = t)) > a.n, named_struct('total', t, 'n', size(filter(near, x -> x = t))), a))"


def w14_fallback_fill(s) -> DataFrame:
    """Unread pages as starts of a document of the local total, hardly sure: the most frequent total around, if enough of
    the reads there agree, else the file's."""
    return s.sql(f"""
        SELECT pdf, page, COALESCE(curr, 1) AS curr, CASE WHEN curr IS NOT NULL THEN total WHEN m.n >= 0.85D * size(near) AND m.n > 0 THEN m.total ELSE usual END AS total,
          CASE WHEN curr IS NULL THEN 'inferred' ELSE 'direct' END AS method, CASE WHEN curr IS NULL THEN 0.15D ELSE 1.0D END AS confidence
        FROM (SELECT *, {_MODE} AS m FROM ({_AROUND}) AS a) AS b""")


def w15_period_evidence(s) -> DataFrame:
    """For every inferred page of a file with a period: the pages at its place in other cycles, and their weights. Nearer
    and read ones weigh more; a page's weights sum to 1."""
    return s.sql("""
        SELECT pdf, page, curr, total, round(w / sum(w) OVER (PARTITION BY pdf, page), 9) AS weight
        FROM (SELECT a.pdf, a.page, c.curr, c.total, sum(CASE WHEN c.method = 'direct' THEN 1.0D ELSE 0.5D END / a.k) AS w
          FROM (SELECT f.pdf, f.page, k, explode(array(CAST(f.page - k * p.period AS INT), CAST(f.page + k * p.period AS INT))) AS at
            FROM (SELECT *, explode(sequence(1, 7)) AS k FROM {filled} WHERE method = 'inferred') AS f JOIN {file_periods} AS p ON p.pdf = f.pdf WHERE p.period > 0) AS a
          JOIN {filled} AS c ON c.pdf = a.pdf AND c.page = a.at WHERE c.curr IS NOT NULL GROUP BY a.pdf, a.page, c.curr, c.total) AS e""")


def w17_contradictions(s) -> DataFrame:
    """Pages that are changed because nearly all reads of the file declare another total, and the inferred ones after them.

    In a run of inferred and contradicting pages, all from the first contradicting one on count up in documents of the
    expected total."""
    return s.sql("""
        SELECT pdf, page, curr, total, fixed_curr, fixed_total
        FROM (SELECT pdf, page, curr, total, CAST(CASE WHEN first IS NOT NULL THEN (first.number - 1 + page - first.page) % expected_total + 1 ELSE curr END AS INT) AS fixed_curr, CAST(CASE WHEN first IS NOT NULL THEN expected_total ELSE total END AS INT) AS fixed_total
          FROM (SELECT *, min(CASE WHEN wrong THEN struct(page, CASE WHEN curr BETWEEN 1 AND expected_total THEN curr ELSE 1 END AS number) END) OVER (PARTITION BY pdf, run ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first
            FROM (SELECT *, sum(CASE WHEN method = 'inferred' OR wrong THEN 0 ELSE 1 END) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
              FROM (SELECT *, method = 'direct' AND total <> expected_total AS wrong, avg(CASE WHEN method = 'direct' THEN CASE WHEN total = expected_total THEN 1.0D ELSE 0.0D END END) OVER (PARTITION BY pdf) AS agreed
                FROM (SELECT f.*, p.expected_total FROM {filled} AS f JOIN {file_periods} AS p ON p.pdf = f.pdf WHERE p.period IS NOT NULL AND p.confidence >= 0.5D AND p.expected_total IS NOT NULL) AS a) AS b WHERE agreed >= 0.90D) AS c) AS d) AS e
        WHERE curr IS DISTINCT FROM fixed_curr OR total IS DISTINCT FROM fixed_total""")


def w18_orphan_suppression(s) -> DataFrame:
    return s.sql("SELECT pdf, page, method FROM {inferred} WHERE method = 'excluded' OR (method = 'inferred' AND curr = 1)")


_NEAR = "filter(transform(sequence(greatest(0, i - 5), least(size(p) - 1, i + 5)), j -> IF(j < i AND d[j].dropped, NULL, p[j].total)), x -> x IS NOT NULL)"
_DROPPED = f"""
    aggregate(sequence(0, size(p) - 1), CAST(array() AS ARRAY<STRUCT<dropped: BOOLEAN, sure: DOUBLE>>), (d, i) -> concat(d, transform(array({_NEAR}), near -> transform(array({_MODE}),
      m -> IF(p[i].total = 1 AND m.total > 1 AND m.n / CAST(greatest(1, size(near)) AS DOUBLE) >= 0.60D, named_struct('dropped', 1.0D - m.n / CAST(greatest(1, size(near)) AS DOUBLE) < 0.30D, 'sure', 1.0D - m.n / CAST(greatest(1, size(near)) AS DOUBLE)), named_struct('dropped', false, 'sure', 1.0D)))[0])))"""


def w19_anomaly_dropout(s) -> DataFrame:
    """Pages whose read is dropped for declaring one page among longer documents. Pages are folded in order in the JVM: a
    read that was dropped no longer counts around those after it."""
    return s.sql(f"""
        SELECT pdf, x.p.page AS page, round(x.d.sure, 9) AS confidence, CASE WHEN x.d.dropped THEN 'failed' ELSE 'direct' END AS method
        FROM (SELECT pdf, explode(arrays_zip(p, d)) AS x FROM (SELECT pdf, p, {_DROPPED} AS d FROM (SELECT pdf, sort_array(collect_list(struct(page, total))) AS p FROM {{page_reads}} GROUP BY pdf) AS f) AS g) AS h WHERE x.p.total = 1""")


def reinferred(page: Sequence[int], x: Inference, corrections: dict[int, Page], exclusions: set[int]) -> Inference:
    """Inference once more, after a person has corrected or excluded pages: what was inferred is forgotten first."""
    curr, total, kinds = [], [], []
    for p, own, kind in zip(page, x.pages, x.kinds, strict=True):
        if p in exclusions:
            own, kind = (None, None), "excluded"
        elif p in corrections:
            own, kind = corrections[p], "manual"
        elif kind == "inferred":
            own, kind = (None, None), "failed"
        curr.append(own[0])
        total.append(own[1])
        kinds.append(kind)
    return Inference(curr, total, x.rules, kinds).fill().settle()


def w22_reinference(s) -> DataFrame:
    """All pages after corrections (in the data: the true number of a page in 101) and exclusions (a page in 97)."""

    def solve(page, curr, total, partkey, true_curr, period):
        corrections = {p: (c, t) for p, k, c, t in zip(page, partkey, true_curr, period, strict=True) if k % 101 == 0}
        exclusions = {p for p, k in zip(page, partkey, strict=True) if k % 97 == 1}
        return _paged(reinferred(page, Inference(curr, total).fill().settle(), corrections, exclusions), page)

    return per_file(s["page_reads"], ["page", "curr", "total", "partkey", "true_curr", "period"], solve, _PAGES)


def a28_reliability(s) -> DataFrame:
    """Each document: incomplete, read, or inferred (surely or not) by its least sure page."""
    return s.sql("""
        SELECT pdf, doc, CASE WHEN found <> declared OR NOT in_order THEN 'incomplete' WHEN n_inferred = 0 THEN 'direct' WHEN least_sure >= 0.75 THEN 'inferred_hi' ELSE 'inferred_lo' END AS class
        FROM (SELECT pdf, doc, count(*) AS found, min(declared) AS declared, bool_and(pos = 1 OR method = 'inferred' OR (curr = pos AND total = declared)) AS in_order, count_if(method = 'inferred') AS n_inferred, min(CASE WHEN method = 'inferred' THEN confidence END) AS least_sure
          FROM (SELECT *, row_number() OVER (PARTITION BY pdf, doc ORDER BY page) AS pos, first_value(total) OVER (PARTITION BY pdf, doc ORDER BY page) AS declared
            FROM (SELECT *, sum(CASE WHEN curr = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc FROM {inferred} WHERE curr IS NOT NULL) AS d WHERE doc > 0) AS p GROUP BY pdf, doc) AS r""")


def a27_telemetry(s) -> DataFrame:
    """Each file's pages by how they were found, inferred ones by how sure they are; its documents, complete, out of order
    or short of pages, by their sizes; its period."""
    return s.sql("""
        SELECT t.*, COALESCE(d.complete, 0) AS complete, COALESCE(d.out_of_order, 0) AS out_of_order, COALESCE(d.undercounted, 0) AS undercounted, COALESCE(d.sizes, '') AS sizes, p.period, p.confidence AS period_confidence, p.expected_total
        FROM (SELECT pdf, count(*) AS pages, count_if(method = 'direct') AS direct, count_if(method = 'inferred') AS inferred, count_if(method = 'excluded') AS excluded, count_if(method = 'failed') AS failed, count_if(curr = 1) AS documents,
            count_if(method = 'inferred' AND confidence < 0.50) AS low, count_if(method = 'inferred' AND confidence BETWEEN 0.50 AND 0.60) AS mid, count_if(method = 'inferred' AND confidence > 0.60) AS high,
            count_if(method = 'inferred' AND confidence >= 0.90) AS consistent, count_if(method = 'inferred' AND confidence < 0.45) AS conflicting, round(avg(CASE WHEN method = 'inferred' THEN confidence END), 6) AS mean_confidence FROM {inferred} GROUP BY pdf) AS t
        LEFT JOIN (SELECT pdf, sum(whole) AS complete, sum(broken) AS out_of_order, sum(n - whole - broken) AS undercounted,
            array_join(transform(sort_array(collect_list(struct(declared, n))), x -> concat(x.declared, 'p:', x.n)), ' ') AS sizes
          FROM (SELECT pdf, declared, count(*) AS n, count_if(in_order AND found = declared) AS whole, count_if(NOT in_order) AS broken
            FROM (SELECT pdf, doc, count(*) AS found, min(declared) AS declared, bool_and(pos = 1 OR method = 'inferred' OR (curr = pos AND total = declared)) AS in_order
              FROM (SELECT *, row_number() OVER (PARTITION BY pdf, doc ORDER BY page) AS pos, first_value(total) OVER (PARTITION BY pdf, doc ORDER BY page) AS declared
                FROM (SELECT *, sum(CASE WHEN curr = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc FROM {inferred} WHERE curr IS NOT NULL) AS a WHERE doc > 0) AS b GROUP BY pdf, doc) AS c GROUP BY pdf, declared) AS e GROUP BY pdf) AS d ON d.pdf = t.pdf
        JOIN {file_periods} AS p ON p.pdf = t.pdf""")


#: Rules to replay: those a sweep settled on, and each of its other values in their place.
REPLAYED = [PRODUCTION, *(replace(PRODUCTION, **{k: v}) for k, values in SPACE.items() for v in values if v != getattr(PRODUCTION, k))]


def w27_rule_replay(s, rules: Sequence[Rules] = tuple(REPLAYED)) -> DataFrame:
    """Documents, inferred and excluded pages of all files under each set of rules, and files whose documents are as many as they truly are."""

    tree = stepwise(enumerate(rules))

    def solve(files):
        sums = np.zeros((len(rules), 5), np.int64)  # of a batch, by rules
        for _, _, curr, total, true_curr in files:
            truth = sum(c == 1 for c in true_curr)
            for pages, kinds, own in replayed(curr, total, tree):
                n = sum(n == 1 for n, _ in pages)
                sums[own] += (n, kinds.count("inferred"), kinds.count("excluded"), n == truth, 1)
        return [(k, *own) for k, own in enumerate(sums.tolist()) if own[-1]]

    names = ("documents", "inferred", "excluded", "exact", "files")
    found = solved(gathered(s["page_reads"], ["page", "curr", "total", "true_curr"]), solve, "config int, " + ", ".join(f"{n} bigint" for n in names))
    return found.groupBy("config").agg(*(F.sum(n).alias(n) for n in names))


def _merge(doc, pages, inferred, total, read_start) -> Iterable[tuple]:
    """Merges the next document into a short one where it fits, declares the same total and has no read start."""
    out: list[list] = []
    for d, n, t, read in zip(doc, (a + b for a, b in zip(pages, inferred, strict=True)), total, read_start, strict=True):
        if out and out[-1][1] < out[-1][2] and out[-1][1] + n <= out[-1][2] and t == out[-1][2] and not read:
            out[-1][1] += n
            out[-1][3] += 1
        else:
            out.append([d, n, t, 0])
    return map(tuple, out)


def w20_undercount_recovery(s) -> DataFrame:
    read = s["segmented"].filter("pos = 1").select("pdf", "doc", (F.col("status") == "direct").alias("read_start"))
    docs = s["segments"].join(read, ["pdf", "doc"])
    return per_file(docs, ["doc", "pages", "inferred", "declared_total", "read_start"], _merge, "pdf bigint, doc bigint, found bigint, total int, merged int")


def _apart(gap: int):
    """Rows (pdf, page, period) of starts, sorted, with whether each stays; a task holds one undecided start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        off = lambda x, base, period: min((x - base) % period, (base - x) % period)
        file, last, base, rows = None, None, None, []  # last: the start before, which may still go; base: the last that stays
        shape = pa.schema([("pdf", pa.int64()), ("page", pa.int32()), ("kept", pa.bool_())])

        def decided(page: int, stays: bool) -> None:
            rows.append((file, page, stays))

        for b in batches:
            for pdf, page, period in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pdf != file:
                    if last is not None:
                        decided(last, True)
                    file, last, base = pdf, None, None
                if period is None:  # no clear period: all stay
                    decided(page, True)
                    continue
                if last is not None and page - last < gap:
                    if base is not None and off(last, base, period) < off(page, base, period):
                        decided(page, False)
                        decided(last, True)
                        base, last = last, None
                        continue
                    decided(last, False)
                elif last is not None:
                    decided(last, True)
                    base = last
                last = page
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                rows = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([last], pa.int32()), pa.array([True])], schema=shape)

    return run


def w21_min_gap(s, gap: int = PRODUCTION.least_gap) -> DataFrame:
    """Starts, and whether each stays: in files with a clear period of two gaps at least, of two starts closer than the gap
    the earlier goes, or the later if it fits the period less well, counted from the start that stays before them."""
    starts = s.sql(f"SELECT r.pdf, r.page, CASE WHEN p.period >= {2 * gap} AND p.confidence >= 0.4D THEN p.period END AS period FROM {{page_reads}} AS r JOIN {{file_periods}} AS p ON p.pdf = r.pdf WHERE r.curr = 1")
    return starts.repartition("pdf").sortWithinPartitions("pdf", "page").mapInArrow(_apart(gap), "pdf bigint, page int, kept boolean")


#: Relations that SQL may name.
FRAMES: dict[str, Callable] = {"filled": filled, "inferred": inferred, "file_periods": w08_file_period}
OPERATORS: dict[str, Callable] = {f.__name__: f for f in (w07_autocorrelation, w08_file_period, w11_gap_solver, w12_orphan_candidates, w13_cross_validation, w14_fallback_fill, w15_period_evidence, w16_inference, w17_contradictions, w18_orphan_suppression, w19_anomaly_dropout, w20_undercount_recovery, w21_min_gap, w22_reinference, w27_rule_replay, a27_telemetry, a28_reliability)}
SQL: dict[str, str] = {
    # one page after the other, with what is left of the five before it
    "w19_anomaly_dropout": """
        SELECT pdf, page, round(sure, 9) AS confidence, CASE WHEN dropped THEN 'failed' ELSE 'direct' END AS method FROM (
          WITH RECURSIVE e AS (SELECT pdf, page, total, list(total) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS ahead FROM {page_reads}),
          r AS (SELECT DISTINCT pdf, 0 AS page, CAST(NULL AS INT) AS total, CAST([] AS INT[]) AS prev, false AS dropped, 1.0::DOUBLE AS sure FROM e
            UNION ALL SELECT e.pdf, e.page, e.total, list_append(r.prev, CASE WHEN z.lost THEN NULL ELSE e.total END)[-5:], z.lost, CASE WHEN y.off THEN 1.0::DOUBLE - m.share ELSE 1.0::DOUBLE END
            FROM r JOIN e ON e.pdf = r.pdf AND e.page = r.page + 1, LATERAL (SELECT list_filter(list_concat(r.prev, e.ahead), lambda x: x IS NOT NULL) AS near) AS n,
              LATERAL (SELECT list_max(list_transform(range(1, len(near) + 1), lambda k: row(len(list_filter(near, lambda x: x = near[k])), -k))) AS most) AS b,
              LATERAL (SELECT near[-most[2]] AS common, most[1] / CAST(len(near) AS DOUBLE) AS share) AS m, LATERAL (SELECT COALESCE(e.total = 1 AND common > 1 AND share >= 0.60::DOUBLE, false) AS off) AS y,
              LATERAL (SELECT y.off AND 1.0::DOUBLE - m.share < 0.30::DOUBLE AS lost) AS z)
          SELECT * FROM r) AS q WHERE total = 1""",
    # each unread page joined with all reads around it, and with all reads of its file
    "w14_fallback_fill": """
        SELECT r.pdf, r.page, COALESCE(r.curr, 1) AS curr, CASE WHEN r.curr IS NOT NULL THEN r.total WHEN l.n >= 0.85::DOUBLE * l.whole THEN l.total ELSE COALESCE(u.total, 2) END AS total,
          CASE WHEN r.curr IS NULL THEN 'inferred' ELSE 'direct' END AS method, CASE WHEN r.curr IS NULL THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END AS confidence
        FROM {page_reads} AS r
        LEFT JOIN (SELECT pdf, page, total, n, whole FROM (SELECT *, sum(n) OVER (PARTITION BY pdf, page) AS whole, row_number() OVER (PARTITION BY pdf, page ORDER BY n DESC, first) AS place
            FROM (SELECT a.pdf, a.page, b.total, count(*) AS n, min(b.page) AS first FROM {page_reads} AS a JOIN {page_reads} AS b ON b.pdf = a.pdf AND b.page BETWEEN a.page - 5 AND a.page + 5 WHERE a.curr IS NULL AND b.total IS NOT NULL GROUP BY a.pdf, a.page, b.total) AS g) AS h WHERE place = 1) AS l ON l.pdf = r.pdf AND l.page = r.page
        LEFT JOIN (SELECT pdf, first(total ORDER BY n DESC, first) AS total FROM (SELECT pdf, total, count(*) AS n, min(page) AS first FROM {page_reads} WHERE total IS NOT NULL GROUP BY pdf, total) AS t GROUP BY pdf) AS u ON u.pdf = r.pdf""",
}
