"""Secret scan: plain patterns, and formats inferred from labelled credentials.

*Base spans* are the matches of three fixed patterns.  They are also the labels: the
values of the assignments, the access keys and the hexadecimal runs found in the corpus
are credentials of their kind.  From them grammars are inferred:

1. A sample of a kind forms a prefix tree with the number of values that pass and end
   in each state; of a longer value its first ``SAMPLE_CHARS`` characters.
2. States are merged, in the order of the shortest strings that reach them, where their
   ends and their next characters are statistically compatible (Hoeffding's bound for
   the two proportions), and all that follows them too.  What is left is a
   probabilistic automaton: long fixed beginnings stay chains, random parts become
   loops.
3. All distinct values of the kind, at their whole length, run through the automaton and
   are counted.  Those that it cannot follow through their first ``SAMPLE_CHARS``
   characters are left to the next automaton of the kind, made from a sample of them in
   the same way, until fewer than ``LEAST`` are left.
4. A candidate is any run of twelve or more of the characters that values are made of.
   Its *likelihood* is that of the automaton; it is a credential of the kind if it is as
   likely, per character, as nearly all values are under a fit without them, and
   much more likely than under the frequencies of character pairs in the corpus outside the labelled
   values.  Its span joins the base spans unless one of them covers it.

All candidates of all documents are scored whose lengths lie within those of an
automaton's values.  The sample, the ``SAMPLE`` distinct values with the smallest hashes,
bounds what the driver merges at a time and gives the states alone: counts, lengths and
thresholds are of every distinct value, pair frequencies of every document.  Fewer than
``LEAST`` distinct values make no automaton: a kind without one keeps its base spans alone.

Null and empty texts hold nothing; repeated rows are scanned each by itself; candidates
of equal likelihood in two kinds take the first kind; an empty table gives an empty
result; columns beside the two used are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .chunks import Generations
from .common import materialise, require_columns, text_slices, worker_state

# Kinds in the order of the result, and their patterns.
KINDS = ("assign", "access", "hex")
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = "[A-Za-z0-9+/_.=-]"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_CANDIDATE = 12, 18, 16, 12

SAMPLE, SAMPLE_CHARS, LEAST = 2_000, 128, 20
#: Confidence of the merge test; odds against the background, in nats; values left out as untypical.
ALPHA, ODDS, TAIL = 0.05, 12.0, 0.02

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
END = len(ALPHABET)
#: Pairs of two value characters among all pairs.
INSIDE = np.arange((END + 1) ** 2) % (END + 1) != END
INSIDE[END * (END + 1):] = False


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def patterns():
    key = "|".join(map(any_case, KEY_WORDS))
    return (re.compile(rf"""(?:{key})["']?\x20*[:=]\x20*["']?({VALUE}+)"""),
            re.compile(f"{VALUE}{{{LEAST_CANDIDATE},}}"), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


class Patterns:
    """Base spans and candidates of a text."""

    def __init__(self):
        self.assign, self.candidate, self.access, self.hex = patterns()
        self.cue = "(?i)" + "|".join(KEY_WORDS)

    def base(self, text: str, may_assign: bool = True):
        """([(kind, start, end, value)], [(start, candidate)]) in order of their starts.

        Access keys and hexadecimal runs long enough to count lie inside candidates.
        """
        spans = []
        if may_assign:
            spans += [(0, m.start(), m.end(), m[1]) for m in self.assign.finditer(text) if len(m[1]) >= LEAST_VALUE]
        candidates = [(m.start(), m[0]) for m in self.candidate.finditer(text)]
        for at, run in candidates:
            if "AKIA" in run:
                spans += [(1, at + m.start(), at + m.end(), m[0]) for m in self.access.finditer(run)
                          if len(m[0]) >= LEAST_ACCESS]
            if len(run) >= LEAST_HEX:
                spans += [(2, at + m.start(), at + m.end(), m[0]) for m in self.hex.finditer(run)
                          if len(m[0]) >= LEAST_HEX]
        spans.sort(key=lambda s: (s[1], s[0]))
        return spans, candidates


def scan(of: Patterns, texts):
    """``base`` of each text of an Arrow array; None where there is neither span nor candidate."""
    import pyarrow.compute as pc
    filled = pc.fill_null(texts, "")
    cues = pc.match_substring_regex(filled, of.cue).to_pylist()
    return [of.base(text, cue) for text, cue in zip(filled.to_pylist(), cues)]


# -- grammar inference ------------------------------------------------------------------

class PrefixTree:
    """States with their passing and ending counts; state 0 is the beginning."""

    def __init__(self, values):
        self.passed, self.ended, self.next = [0], [0], [{}]
        for value in values:
            state = 0
            self.passed[0] += 1
            for c in value[:SAMPLE_CHARS]:
                step = self.next[state].get(c)
                if step is None:
                    step = self.next[state][c] = len(self.passed)
                    self.passed.append(0)
                    self.ended.append(0)
                    self.next.append({})
                state = step
                self.passed[state] += 1
            self.ended[state] += len(value) <= SAMPLE_CHARS


def differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    """Hoeffding's bound: whether two proportions are surely not the same."""
    return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (
        1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def compatible(tree: PrefixTree, a: int, b: int, alpha: float) -> bool:
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        n, m = tree.passed[a], tree.passed[b]
        if differ(tree.ended[a], n, tree.ended[b], m, alpha):
            return False
        after_a, after_b = tree.next[a], tree.next[b]
        for c in after_a.keys() | after_b.keys():
            x, y = after_a.get(c), after_b.get(c)
            if differ(tree.passed[x] if x is not None else 0, n, tree.passed[y] if y is not None else 0, m, alpha):
                return False
            if x is not None and y is not None and x != y:
                waiting.append((x, y))
    return True


def fold(tree: PrefixTree, into: int, state: int) -> None:
    """Add the tree below ``state`` to the automaton at ``into``."""
    waiting = [(into, state)]
    while waiting:
        into, state = waiting.pop()
        tree.passed[into] += tree.passed[state]
        tree.ended[into] += tree.ended[state]
        own = tree.next[into]
        for c, below in tree.next[state].items():
            if c in own:
                waiting.append((own[c], below))
            else:
                own[c] = below


class Automaton:
    """A probabilistic automaton over the value characters, as tables for whole batches.

    ``step[state, character]`` and ``cost[state, character or end]`` in nats.  What the
    sample never did in a state has the weight of one value, shared by all characters;
    it leads to the state ``states`` in which all of them are equally costly, and past
    ``SAMPLE_CHARS`` characters to the last state, that of the tails of long values.
    """

    def __init__(self, values, alpha: float = ALPHA, folds: int = 2):
        values = sorted(values)
        tree = PrefixTree(values)
        kept, border = [0], [(0, c, s) for c, s in sorted(tree.next[0].items())]
        while border:
            origin, c, state = border[0]
            for old in kept:
                if compatible(tree, old, state, alpha):
                    tree.next[origin][c] = old
                    fold(tree, old, state)
                    break
            else:
                kept.append(state)
            held = set(kept)
            border = [(k, c, s) for k in kept for c, s in sorted(tree.next[k].items()) if s not in held]
        number = {state: i for i, state in enumerate(kept)}
        self.states = n = len(kept)
        self.step = np.full((n + 2, END), n, np.int32)
        self.step[n + 1] = n + 1
        for state, i in number.items():
            for c, after in tree.next[state].items():
                self.step[i, CODE[ord(c)]] = number[after]
        self.cost = costs(passages(self.step, values)[0])        # the sample's way through the merged states
        self.shortest, self.longest = min(map(len, values)), max(map(len, values))
        # cost per character of values that the automaton was not made of: fit without each fold in turn
        self.typical, self.without, self.fold_of = math.inf, [], {}
        if 1 < folds <= len(values):
            each = []
            for k in range(folds):
                held = values[k::folds]
                self.fold_of.update(dict.fromkeys(held, k))
                own = Automaton([v for i, v in enumerate(values) if i % folds != k], alpha, folds=0)
                self.without.append(own.step)
                each.append(likelihood_cost(own.step, own.cost, held, len(own.step) - 1)
                            / (np.array([*map(len, held)]) + 1))
            self.typical = float(np.quantile(np.concatenate(each), 1 - TAIL))


def costs(times):
    return -np.log((times + 1 / (END + 1)) / (times.sum(axis=1, keepdims=True) + 1))


def codes_of(value: str):
    return CODE[np.frombuffer(value.encode("ascii"), np.uint8)]


def longest_first(values):
    lengths = np.array([*map(len, values)], np.int64)
    return lengths, np.argsort(-lengths, kind="stable")


def walk(step, values, tail=None):
    """(n, states, characters) at each place: of the ``n`` longest values, all one character further at a time.

    With ``tail``, what has left the automaton is in that state past ``SAMPLE_CHARS`` characters.
    """
    lengths, order = longest_first(values)
    codes = codes_of("".join(values))
    begin = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    state = np.zeros(len(values), np.int64)
    for k in range(int(lengths[0]) if len(values) else 0):
        n = int(np.searchsorted(-lengths, -k, side="left"))          # those longer than k
        code = codes[begin[:n] + k]
        yield n, state[:n], code
        after = step[state[:n], code]
        if tail is not None and k >= SAMPLE_CHARS:
            after = np.where(after == tail - 1, tail, after)
        state[:n] = after
    yield len(values), state, np.full(len(values), END)


def likelihood_cost(step, cost, values, tail=None):
    """Nats of each value under an automaton."""
    total, out = np.zeros(len(values)), np.empty(len(values))
    for n, state, code in walk(step, values, tail):
        total[:n] += cost[state, code]
    out[longest_first(values)[1]] = total
    return out


def passages(step, values):
    """How often the values leave each state by each character or end, and which of them the automaton follows.

    Nothing is counted in the state of what was never seen.
    """
    unseen = len(step) - 2
    times, lost, followed = np.zeros(len(step) * (END + 1)), np.zeros(len(values), bool), np.empty(len(values), bool)
    for n, state, code in walk(step, values, unseen + 1):
        lost[:n] |= state == unseen
        np.add.at(times, state * (END + 1) + code, 1)
    followed[longest_first(values)[1]] = ~lost
    times = times.reshape(len(step), END + 1)
    times[unseen] = 0
    return times, followed


class Formats:
    """The automata of the kinds and the corpus's pair frequencies.

    ``automata``: kind, step, cost, shortest and longest value and typical cost of each.
    """

    def __init__(self, automata: list, pairs, odds: float = ODDS):
        self.automata, self.odds = automata, odds
        # in the background a state is the character before; the last one is the beginning
        self.before = np.tile(np.arange(END, dtype=np.int32), (END + 1, 1))
        self.pair_cost = costs(np.asarray(pairs, float))

    def background(self, values):
        begun = np.vstack((self.pair_cost[END:], self.pair_cost[:END]))      # state 0 is the beginning
        return likelihood_cost(self.before + 1, begun, values)

    def kinds(self, values):
        """The kind of each value, -1 where no format is typical and likely enough."""
        best, found = np.full(len(values), np.inf), np.full(len(values), -1, np.int64)
        sizes = np.array([*map(len, values)], np.int64)
        for kind, step, cost_of, shortest, longest, typical in self.automata:
            at = np.flatnonzero((sizes >= shortest) & (sizes <= longest))
            if not len(at):
                continue
            own = [values[i] for i in at]
            cost = likelihood_cost(step, cost_of, own, len(step) - 1)
            fits = (cost / (sizes[at] + 1) <= typical) & (self.background(own) - cost >= self.odds)
            better = fits & (cost < best[at])
            best[at[better]], found[at[better]] = cost[better], kind
        return found


def neighbours(texts):
    """A number for each pair of neighbouring bytes of the texts."""
    raw = np.frombuffer("\n".join(t or "" for t in texts).encode(), np.uint8)
    kind = np.full(256, END, np.int32)
    kind[:128] = np.where(CODE >= 0, CODE, END)
    codes = np.concatenate(([END], kind[raw], [END]))
    return codes[:-1] * (END + 1) + codes[1:]


# -- Spark jobs ---------------------------------------------------------------------------

def labelled(docs: DataFrame, text: str) -> tuple[DataFrame, np.ndarray]:
    """The distinct labelled values (kind, value), and the counts of the corpus's character pairs.

    A pair is of two neighbouring value characters, or of one and the border of its run;
    one number per pair of characters reaches the driver.
    """
    def gather_labels(batches):
        import pyarrow as pa
        of = Patterns()
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                spans = [(kind, value) for spans, _ in scan(of, batch.column(0)) for kind, _, _, value in spans]
                values = Counter(spans)
                # the pairs of the slice, without those inside its labelled values
                times = np.bincount(neighbours(batch.column(0).to_pylist()), minlength=(END + 1) ** 2)
                own = np.bincount(neighbours([value for _, value in spans]), minlength=(END + 1) ** 2)
                times[INSIDE] = np.maximum(times - own, 0)[INSIDE]
                pairs = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind for kind, _ in values] + [-1] * len(pairs), pa.int32()),
                     pa.array([value for _, value in values] + [str(p) for p in pairs.tolist()], pa.string()),
                     pa.array([*values.values(), *times[pairs].tolist()], pa.int64())], names=["kind", "value", "n"])

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(gather_labels, "kind int, value string, n long")
    found = materialise(rows.groupBy("kind", "value").agg(F.sum("n").alias("n")), "secret-labels")
    pairs = np.zeros((END + 1, END + 1))
    for row in found.where("kind = -1").collect():          # at most one row per pair of characters
        pairs[divmod(int(row.value), END + 1)] = row.n
    pairs[END, END] = 0                                      # neither is a value character
    return found.where("kind >= 0").select("kind", "value"), pairs


def drawn(values: DataFrame, counts: dict, sample: int) -> dict:
    """The values of each kind with the ``sample`` smallest hashes, as (kind: beginnings).

    Of longer ones the first ``SAMPLE_CHARS`` characters and one more.  About twice as many
    reach the driver: those below the hash that as many should be below.
    """
    share = 2.0
    hashed = values.select("kind", F.xxhash64("value").alias("h"), F.substring("value", 1, SAMPLE_CHARS + 1).alias("begin"))
    while True:
        most = {k: min(1.0, share * sample / n) for k, n in counts.items()}
        low = [(F.col("kind") == k) & (F.col("h") <= int(of * (2 ** 64 - 1)) - 2 ** 63 if of < 1 else F.lit(True))
               for k, of in most.items()]
        found = {k: [] for k in counts}
        for row in hashed.where(reduce(or_, low)).collect():
            found[row.kind].append((row.h, row.begin))
        if all(len(found[k]) >= min(sample, n) for k, n in counts.items()):
            return {k: [begin for _, begin in sorted(rows)[:sample]] for k, rows in found.items()}
        share *= 2


def infer(values: DataFrame, sample: int = SAMPLE, alpha: float = ALPHA) -> list:
    """The automata of all kinds, as in ``Formats``, from the distinct ``values`` (kind, value).

    A sample at a time gives the states; all values are counted in them on the executors, and
    those that the automaton of their kind cannot follow make the next ones.  Each automaton
    follows at least its own sample, so the rounds come to an end.
    """
    automata = []
    while True:
        counts = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect() if r["count"] >= LEAST}
        if not counts:
            return sorted(automata, key=lambda x: x[0])
        fits = {}
        for kind, begins in sorted(drawn(values, counts, sample).items()):
            of = Automaton(begins, alpha)
            if counts[kind] <= sample and of.longest <= SAMPLE_CHARS:            # made of all values, whole
                automata.append((kind, of.step, of.cost, of.shortest, of.longest, of.typical))
            else:
                fits[kind] = of
        if not fits:
            return sorted(automata, key=lambda x: x[0])
        values = values.where(F.col("kind").isin(*fits))
        whole, values = counted(values, {k: ([of.step, *of.without], of.fold_of) for k, of in fits.items()})
        automata += whole


def counted(values: DataFrame, fits: dict) -> tuple[list, DataFrame]:
    """Automata with the counts of all ``values`` that they follow, and the values that they do not.

    ``fits``: by kind the steps of the automaton and of those without each fold, and the fold of
    each beginning in the sample; the fold of any other value is by its checksum.  Each value counts
    in the automata made without its fold's like, and its cost is that under the one without it.
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(fits)

    def parts(batches):
        """(kind, values, their folds, followed) of the slices."""
        for whole in batches:
            for batch in text_slices(whole, "value"):
                kinds = batch.column(0).to_numpy()
                for kind, (steps, fold_of) in shared.value.items():
                    own = batch.column(1).take(np.flatnonzero(kinds == kind)).to_pylist()
                    if own:
                        folds = np.array([f if (f := fold_of.get(v[:SAMPLE_CHARS + 1])) is not None
                                          else zlib.crc32(v.encode()) % (len(steps) - 1) for v in own])
                        yield kind, own, folds, *passages(steps[0], own)

    def count(batches):
        import pyarrow as pa
        for kind, own, folds, _, followed in parts(batches):
            for of, step in enumerate(shared.value[kind][0]):
                times = passages(step, [v for v, f, ok in zip(own, folds, followed) if ok and f != of - 1])[0].ravel()
                cells = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), x), pa.int32()) for x in (kind, of)]
                    + [pa.array(cells, pa.int64()), pa.array(times[cells].astype(np.int64))], names=["kind", "of", "cell", "n"])

    tables = {kind: [np.zeros(len(step) * (END + 1)) for step in steps] for kind, (steps, _) in fits.items()}
    cells = values.mapInArrow(count, "kind int, of int, cell long, n long").groupBy("kind", "of", "cell").agg(F.sum("n").alias("n"))
    for row in cells.collect():                              # at most one row per state and character
        tables[row.kind][row.of][row.cell] = row.n
    priced = spark.sparkContext.broadcast(
        {kind: [costs(t.reshape(-1, END + 1)) for t in times] for kind, times in tables.items()})

    def price(batches):
        import pyarrow as pa
        for kind, own, folds, _, followed in parts(batches):
            cost = np.empty(len(own))
            for f in range(len(priced.value[kind]) - 1):
                at, step = np.flatnonzero(folds == f), shared.value[kind][0][f + 1]
                cost[at] = likelihood_cost(step, priced.value[kind][f + 1], [own[i] for i in at], len(step) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(own), pa.int32()), pa.array(own, pa.string()), pa.array(followed),
                 pa.array(cost / (np.array([*map(len, own)]) + 1))], names=["kind", "value", "followed", "cost"])

    scored = materialise(values.mapInArrow(price, "kind int, value string, followed boolean, cost double"), "secret-costs")
    sizes = scored.where("followed").groupBy("kind").agg(
        F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"),
        F.percentile_approx("cost", 1 - TAIL, 10_000).alias("typical"))
    whole = [(r.kind, fits[r.kind][0][0], priced.value[r.kind][0], r.shortest, r.longest, r.typical) for r in sizes.collect()]
    return whole, scored.where("not followed").select("kind", "value")


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE,
                 alpha: float = ALPHA, odds: float = ODDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_inferred, found.

    ``found``: array of (kind, start, end, value) of all spans; the counts and the digest
    are of the base spans, ``n_inferred`` of those that the automata add.
    """
    require_columns(docs, text, doc_id)
    values, pairs = labelled(docs, text)
    automata = infer(values, sample, alpha)
    shared = docs.sparkSession.sparkContext.broadcast((automata, pairs))
    key = hashlib.sha256(repr((odds, [(x[0], *x[3:]) for x in automata])).encode() + pairs.tobytes()
                         + b"".join(x[1].tobytes() + x[2].tobytes() for x in automata)).hexdigest()
    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    span = "struct<kind:string,start:long,end:long,value:string>"

    def run(batches):
        import pyarrow as pa
        of, formats = Patterns(), Formats(*shared.value, odds)
        seen = worker_state(("secrets", key), lambda: Generations(400_000))
        types = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                    ("value", pa.string())]))
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                texts = scan(of, batch.column(1))
                runs = {run for _, candidates in texts for _, run in candidates}
                known = {run: kind for run in runs if (kind := seen.get(run)) is not None}
                new = [run for run in runs if run not in known]
                known.update((run, seen.put(run, kind)) for run, kind in zip(new, formats.kinds(new).tolist()))
                rows = [result(spans, [(known[run], at, at + len(run), run) for at, run in candidates if known[run] >= 0])
                        for spans, candidates in texts]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]),
                     pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()),
                     pa.array(columns[5], pa.int64()), pa.array(columns[6], types)],
                    names=["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_inferred", "found"])

    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(
        run, f"_id {kind_of_id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
             f"n_inferred long, found array<{span}>")
    return found.withColumnRenamed("_id", doc_id) if doc_id != "_id" else found


def result(base, inferred):
    """One text's row: counts by kind, digest, spans, number of inferred spans, all spans."""
    added = [s for s in inferred if not any(a <= s[1] and s[2] <= b for _, a, b, _ in base)]
    written = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in base)
    every = sorted(base + added, key=lambda s: (s[1], s[0], s[2]))
    return (*(sum(s[0] == k for s in base) for k in range(len(KINDS))),
            hashlib.sha256(written.encode()).hexdigest(),
            ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in every), len(added),
            [{"kind": KINDS[k], "start": a, "end": b, "value": v} for k, a, b, v in every])
