"""Personal data: exact patterns, and what a learned tagger finds beyond them.

Patterns give the base spans.  A bidirectional LSTM with a conditional random
field over characters learns from such spans, from forms of them that the
patterns don't cover, and from numbers that are none, and reads overlapping
windows.  A span that reaches its window's border is joined to its neighbour's;
of the spans of all windows of a text the set of the largest total weight without
overlaps stays.  A span that the patterns don't give is added if the model is
sure and an exact check of its kind's form agrees.

Every span of these kinds holds a digit or an at sign, so the windows that hold
one, and those beside them, are all that can give a span.

The model learns from a bounded sample: of each kind the ``PER_KIND`` spans, with
what stands around them, that have the smallest hashes in the whole table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm import char_tagger
from wayfold.llm.char_tagger import Tagger, classes, padded
from wayfold.llm.spans import text_bytes
from wayfold.llm.workers import tidy

KINDS = ("email", "ip", "card", "phone")
#: Examples of a kind (and of numbers that are none), characters around each, the longest span learned from.
PER_KIND, AROUND, LONGEST = 150, 20, 64
#: Times that each example is used with other forms in its place.
FORMS = 3
#: Characters of a window, and from one window to the next; windows tagged at a time.
WINDOW, STRIDE, AT_ONCE = 160, 96, 256
#: Least probability of each character of an added span.
SURE = 0.9
#: Bytes and documents that are worked on at a time; a longer text is taken alone.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 1024

Span = tuple[int, int, int]  # kind, start, end

# ---------------------------------------------------------------- patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ANCHORS, _SPACE = re.compile(r"[0-9@]"), re.compile(r"\s")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 * (d > 9) for d in even)) % 10 == 0


def byte_part(part: str) -> bool:
    least = part.lstrip("0")
    return len(least) <= 3 and int(least or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from their at signs: a run of characters is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:  # back to where the run before the sign begins, a stretch at a time
            step = max(done, start - 128)
            cut = None
            for cut in _NOT_LOCAL.finditer(text, step, start):
                pass
            start = cut.end() if cut else step
            if cut:
                break
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each chain of numbers and dots."""
    for m in _CHAIN.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(byte_part, four)):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    """By kind, then start: leftmost matches without overlap within a kind, less those whose numbers fail."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        found += [(1, a, b) for a, b in addresses(text)]
        found += [(2, a, b) for a, b in cards(text)]
    if "+" in text:
        found += [(3, a, b) for a, b in phones(text)]
    return found


# ---------------------------------------------------------------- check of added spans
_EMAIL_FORM = re.compile(r"[^\s@]*[^\W_][^\s@]*(?:@|\[@\])[^\W_][^\s@]*")
_IP_FORM = re.compile(r"([0-9]{1,3})(\.|,|-|_|\[\.\])([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})")
_CARD_FORM = re.compile(r"[0-9]{1,6}(?:[ ./_-]?[0-9]{1,6}){1,7}")
_PHONE_FORM = re.compile(r"[+(]?[0-9][0-9 ().+/-]*[0-9]")


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span has its kind's form and stands apart from letters and digits around it."""
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    own = text[start:end]
    digits = "".join(_DIGITS.findall(own))
    if kind == 0:
        return _EMAIL_FORM.fullmatch(own) is not None
    if kind == 1:
        m = _IP_FORM.fullmatch(own)
        return m is not None and all(map(byte_part, m.group(1, 3, 4, 5)))
    if kind == 2:
        return 13 <= len(digits) <= 19 and _CARD_FORM.fullmatch(own) is not None and luhn(digits)
    return 7 <= len(digits) <= 15 and len(digits) < len(own) and _PHONE_FORM.fullmatch(own) is not None


# ---------------------------------------------------------------- sample and examples
def apart_from(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether a stretch overlaps none of the spans."""
    taken = sorted((a, b) for _, a, b in spans)
    lows, highs = [a for a, _ in taken], list(accumulate((b for _, b in taken), max, initial=0))
    return lambda start, end: highs[bisect_left(lows, end)] <= start  # none that begins before the end ends after the start


def snippets(text: str) -> Iterator[tuple[int, str, int, int]]:
    """(kind, what stands around a span with it, start, end); the kind after the last is a number that is none."""
    spans = base_spans(text)
    for kind, a, b in spans:
        if b - a <= LONGEST:
            left = max(0, a - AROUND)
            yield kind, text[left : b + AROUND], a - left, b - left
    done, clear = 0, apart_from(spans)
    for m in _ANCHORS.finditer(text):
        if m.start() < done:
            continue
        low, high = max(0, m.start() - LONGEST), m.end() + LONGEST
        start = low + next((c.end() for c in reversed(list(_SPACE.finditer(text[low : m.start()])))), 0)
        gap = _SPACE.search(text, m.end(), high)
        end = gap.start() if gap else min(high, len(text))
        done = end + 2 * AROUND
        if end - start <= LONGEST and clear(start - AROUND, end + AROUND):
            left = max(0, start - AROUND)
            yield len(KINDS), text[left : end + AROUND], start - left, end - left


def sample(docs: DataFrame, per_kind: int = PER_KIND) -> list[tuple[int, str, int, int]]:
    """Distinct snippets of each kind, those with the smallest hashes of the table."""

    @tidy
    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, tuple]] = [{} for _ in range(len(KINDS) + 1)]
        for texts in _texts_with_anchors(batches):
            for text in texts:
                for kind, around, a, b in snippets(text):
                    key = hashlib.blake2b(f"{kind}:{a}:{b}:{around}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
                    kept[kind][key] = (around, a, b)
                    if len(kept[kind]) > 4 * per_kind:
                        kept[kind] = dict(sorted(kept[kind].items())[:per_kind])
        rows = [(kind, key, *x) for kind, own in enumerate(kept) for key, x in sorted(own.items())[:per_kind]]
        kinds, keys, around, a, b = zip(*rows) if rows else ([], [], [], [], [])
        columns = [pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), pa.array(around, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "around", "a", "b"])

    found = docs.select("text").mapInArrow(pick, "kind int, key string, around string, a int, b int").dropDuplicates(["kind", "key"])
    place = F.row_number().over(Window.partitionBy("kind").orderBy("key"))
    # at most per_kind rows of a kind reach the driver
    rows = found.withColumn("place", place).filter(F.col("place") <= per_kind).collect()
    return sorted((r.kind, r.around, r.a, r.b) for r in rows)


def with_check_digit(digits: str) -> str:
    """The digits with the last one changed to fit."""
    return next(digits[:-1] + d for d in "0123456789" if luhn(digits[:-1] + d))


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, [rng.integers(1, 10), *rng.integers(0, 10, n - 1)]))


def _pick(rng: np.random.Generator, options):
    return options[int(rng.integers(len(options)))]


def variant(kind: int, own: str, rng: np.random.Generator) -> str:
    """A form of a span that the patterns don't cover, or another span of its kind."""
    if kind == 0:
        local, _, domain = own.partition("@")
        form = int(rng.integers(5))
        if form == 0:  # no dot after the sign
            return f"{local}@{domain.split('.')[0]}"
        if form == 1:  # a sign between brackets
            return f"{local}[@]{domain}"
        at = int(rng.integers(len(local)))
        odd = _pick(rng, "äéñøßçłжя") if form < 4 else _pick(rng, "!#$&*'/=?^{|}~")
        return f"{local[:at]}{odd}{local[at + 1 :] or 'x'}@{domain}"
    if kind == 1:
        parts = [str(int(p)) for p in rng.integers(0, 256, 4)]
        return _pick(rng, [".", ",", "-", "_", "[.]"]).join(parts)
    if kind == 2:
        d = with_check_digit(_digits(rng, int(rng.integers(13, 20))))
        if len(d) == 15:
            cut = [d[:4], d[4:10], d[10:]]
        else:
            cut = [d[i : i + 4] for i in range(0, len(d), 4)]
        return _pick(rng, ["", " ", "-", ".", "/", "_"]).join(cut)
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return _pick(
        rng,
        [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{a[:2]} {b}{c}", f"0{a}/{b}{c}", f"00{a[:2]} {a} {b}{c}", f"({a}){b}-{c}", f"0{a} {b} {c[:2]} {c[2:]}"],
    )


def distractor(rng: np.random.Generator) -> str:
    """Something with digits or a sign that is no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    word = "".join(chr(97 + c) for c in rng.integers(0, 26, n(3, 9)))
    hexa = "".join(_pick(rng, "0123456789abcdef") for _ in range(n(8, 40)))
    return _pick(
        rng,
        [
            _digits(rng, n(1, 9)), _digits(rng, n(9, 24)), f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}",
            f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 32):02d}", f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1, 13)}/{n(1, 32)}/{n(1900, 2100)}",
            f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 32):02d} {n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", f"{n(0, 24)}:{n(0, 60):02d}", f"{n(1900, 2000)}-{n(2000, 2100)}",
            f"v{n(0, 20)}.{n(0, 30)}.{n(0, 99)}", f"{n(0, 20)}.{n(0, 30)}.{n(0, 99)}", f"{n(1, 100)}%", f"${n(1, 9999)}.{n(10, 99)}", f"@{word}", f"{word}{n(0, 99)}", f"{word}_{n(0, 9999)}",
            hexa, f"{word}={hexa}", f"({n(1, 99)})", f"[{n(1, 99)}]", f"{n(1, 99)}-{n(1, 99)}", f"§ {n(1, 999)}", f"{word}@", f"{n(300, 999)}.{n(300, 999)}.{n(1, 99)}.{n(1, 99)}", f"ISBN 978-{n(0, 9)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 9)}", f"{n(100, 999)} {n(100, 999)} {n(100, 999)}",
        ],
    )


def examples(rows: list[tuple[int, str, int, int]], seed: int = char_tagger.SEED, forms: int = FORMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, tags) of windows: each snippet, a form of its span, and a number that is none in its place."""
    rng, out = np.random.default_rng(seed), []

    def add(kind: int, text: str, a: int, b: int) -> None:
        x, tags = classes(text), np.zeros(len(text), dtype=np.int64)
        for k, s, e in base_spans(text):
            if not (s < b and a < e):
                tags[s], tags[s + 1 : e] = 2 * k + 1, 2 * k + 2
        if kind < len(KINDS):
            tags[a], tags[a + 1 : b] = 2 * kind + 1, 2 * kind + 2
        out.append((x, tags))

    for kind, around, a, b in rows * forms:
        add(kind, around, a, b)
        left, right = around[:a], around[b:]
        if kind < len(KINDS):
            own = variant(kind, around[a:b], rng)
            add(kind, left + own + right, a, a + len(own))
        other = distractor(rng)
        text = left + other + right
        hit = [s for s in base_spans(text) if s[1] < a + len(other) and a < s[2]]
        add(*((hit[0][0], text, hit[0][1], hit[0][2]) if hit else (len(KINDS), text, a, a + len(other))))
    return out


def learn(docs: DataFrame, per_kind: int = PER_KIND) -> Tagger | None:
    """A model of the sample; None if the table has no base span to learn from."""
    rows = sample(docs, per_kind)
    return char_tagger.train(examples(rows), KINDS) if any(kind < len(KINDS) for kind, *_ in rows) else None


# ---------------------------------------------------------------- windows
def window_numbers(anchors: np.ndarray, length: int) -> np.ndarray:
    """The windows that hold an anchor, and those beside them."""
    last = max(0, -(-(length - WINDOW) // STRIDE))
    most = np.minimum(anchors // STRIDE, last)
    least = np.maximum(0, -(-(anchors - WINDOW + 1) // STRIDE))
    near = np.concatenate([np.maximum(0, least - 1), least, most, np.minimum(last, most + 1)])
    return np.unique(near)


def spans_of(tags: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(kind, start, end, least probability of a character) of one window's tags."""
    inside = np.flatnonzero(tags)
    at = 0
    while at < len(inside):
        start, kind = int(inside[at]), (int(tags[inside[at]]) - 1) // 2
        end = start + 1
        while end < len(tags) and tags[end] == 2 * kind + 2:
            end += 1
        yield kind, start, end, float(sure[start:end].min())
        at = int(np.searchsorted(inside, end))


def tag_windows(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    out = []
    for at in range(0, len(texts), AT_ONCE):
        x, lengths = padded([classes(t) for t in texts[at : at + AT_ONCE]])
        scores = tagger.scores(x, lengths)
        tags, (gamma, _, _) = tagger.best(scores, lengths), tagger.marginals(scores, lengths)
        sure = np.take_along_axis(gamma, tags[:, :, None].astype(np.int64), axis=2)[:, :, 0]
        out += [list(spans_of(tags[i, :n], sure[i, :n])) for i, n in enumerate(lengths.tolist())]
    return out


def merged(windows: list[tuple[int, list[tuple[int, int, int, float]]]], length: int) -> list[tuple[int, int, int, float]]:
    """Candidates of a whole text from (start of the window, its spans), by start.

    A span that reaches a border inside the text goes on in the neighbour: it is
    joined to the neighbour's spans of its kind that it meets, and dropped if there are none.
    """
    found: dict[tuple[int, int, int], float] = {}
    open_: list[list] = []  # spans cut at their right end
    for start, spans in windows:
        cut_right, end = [], min(start + WINDOW, length)
        for kind, a, b, sure in ((k, start + a, start + b, p) for k, a, b, p in spans):
            cut_left = a == start and start > 0
            for o in open_:
                if o[0] == kind and o[1] < b and a <= o[2] and o[2] >= start:
                    a, b, sure, cut_left = min(a, o[1]), max(b, o[2]), min(sure, o[3]), cut_left and o[4]
            if b == end < length:
                cut_right.append([kind, a, b, sure, cut_left])
            elif not cut_left:
                key = (kind, a, b)
                found[key] = max(found.get(key, 0.0), sure)
        open_ = cut_right
    return sorted((k, a, b, p) for (k, a, b), p in found.items())


def best_set(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The spans without overlaps whose lengths times probabilities have the largest sum."""
    order = sorted(spans, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    total, take = [0.0], []
    for i, (_, a, b, p) in enumerate(order):
        before = int(np.searchsorted(ends[:i], a, side="right"))
        with_it = total[before] + p * (b - a)
        take.append((with_it > total[i], before))
        total.append(max(total[i], with_it))
    out, i = [], len(order)
    while i:
        used, before = take[i - 1]
        if used:
            out.append(order[i - 1])
        i = before if used else i - 1
    return out[::-1]


# ---------------------------------------------------------------- operator
_ANCHOR = np.zeros(256, dtype=bool)
_ANCHOR[ord("0") : ord("9") + 1] = _ANCHOR[ord("@")] = True


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[int, np.ndarray]]]:
    """Slices of the batches, and for their rows that have any the code points of digits and at signs."""
    for batch in batches:
        data, bounds = text_bytes(batch.column("text").fill_null(""))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), at + BLOCK_DOCS, batch.num_rows)
            own, edges = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            anchors = np.flatnonzero(_ANCHOR[own])
            doc = np.searchsorted(edges, anchors, side="right") - 1
            if len(own) and own.max() >= 0x80:
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                places = points[anchors] - points[edges[doc]]
            else:
                places = anchors - edges[doc]
            cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)).tolist() if len(doc) else []
            yield batch.slice(at, to - at), {int(doc[a]): places[a:b] for a, b in zip(cuts[:-1], cuts[1:])}
            at = to


def _texts_with_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[list[str]]:
    for part, anchors in _blocks(batches):
        yield [part.column("text")[i].as_py() for i in anchors]


def added_spans(tagger: Tagger | None, texts: list[str], anchors: list[np.ndarray], base: list[list[Span]]) -> list[list[Span]]:
    """What the model adds to each text's base spans, by kind and start."""
    if tagger is None:
        return [[] for _ in texts]
    numbers = [window_numbers(a, len(t)) for a, t in zip(anchors, texts)]
    out, held, starts, pieces = [], [], [], []

    def settle() -> None:
        """Tag what is held, and put the windows of each text together."""
        found, at = tag_windows(tagger, pieces), 0
        for i, n in held:
            own = list(zip(starts[at : at + n], found[at : at + n]))
            at += n
            new, clear = [], apart_from(base[i])
            for kind, a, b, sure in best_set(merged(own, len(texts[i]))):
                if sure >= SURE and clear(a, b) and plausible(kind, texts[i], a, b):
                    new.append((kind, a, b))
            out.append(sorted(new))
        held.clear(), starts.clear(), pieces.clear()

    for i, (text, own) in enumerate(zip(texts, numbers)):
        held.append((i, len(own)))
        starts += (own * STRIDE).tolist()
        pieces += [text[s : s + WINDOW] for s in starts[len(starts) - len(own) :]]
        if len(pieces) >= 4 * AT_ONCE:
            settle()
    settle()
    return out


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans of each document, as array<struct<kind, start, end>>.

    Spans are in code points with exclusive ends, sorted by kind in the order of
    ``KINDS`` and then start.  ``spans`` has the base spans and those that the model
    adds, which overlap none of them nor each other.

    * A null or empty text has none.  Each row has its own result, whatever its doc_id.
    * Without a model only the base spans are found.
    * Other columns are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # of a fixed size
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        for part, anchors in _blocks(batches):
            base: list[list] = [[] for _ in range(part.num_rows)]
            both = list(base)
            rows = list(anchors)
            texts = [part.column("text")[i].as_py() for i in rows]
            found = [base_spans(t) for t in texts]
            for i, own, more in zip(rows, found, added_spans(model.value, texts, list(anchors.values()), found)):
                base[i], both[i] = listed(own), listed(own + more)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(base, kind), pa.array(both, kind)], ["doc_id", "base", "spans"]
            )

    span = "array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id long, base {span}, spans {span}")


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; see :func:`find_personal_data` and :func:`learn`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal_data(docs, learn(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.col("spans")).alias("spans")
    )
