"""Language identification by cross-parsing entropy with suffix automata.

1. For each language, a reference text is gathered from labelled documents: at most ``per_language`` whole texts
   (of each of so many hash buckets the document with the smallest draw), taken in the order of their draws while
   they fit into ``reference`` bytes together. Where none fits, the shortest of them is the reference, whole. Of
   more than ``languages`` languages those with the most labelled documents are learned. This sample of labelled
   rows is all that is bounded; whole texts teach, and whole texts are judged.
2. A suffix automaton of the reference knows all its substrings. Reading a text through it, a phrase goes on
   as long as it occurs in the reference; where it doesn't, the next phrase begins. The fewer phrases, the more
   of the text the reference predicts. A phrase costs log2(length of the longest reference) bits, in all languages
   alike, so that a short reference makes none cheaper; a byte that the reference doesn't have costs UNSEEN more.
3. The language with the least estimate wins; ``score`` is runner-up / (winner + runner-up), from 0.5 to 1.

Texts are lower-cased, and runs of anything but letters and their marks become one space, before and after fitting.

The texts of a batch walk through the automata side by side as arrays, in stretches of WINDOW bytes. A stretch is
first read as if a phrase began there; then from the state in which the stretch before it truly ended. Both readings
nearly always meet within PREFIX bytes, after which they are one; where they don't, the stretch is read again, and
so on until no state changes. The phrases are therefore those of the whole text, read from its first byte.

Automata are kept as rows laid over each other (``Packed``), about 24 bytes for each byte of a reference, so 60
languages take less than 150 MB. Only references travel; each Python worker builds its automata once.

Defined results: null texts and texts without letters are ``und`` with score 0; with one language known the
score is 1; with none every text is ``und``; ties go to the shorter reference, then to the language first by code
point; rows with a null language or without letters teach nothing; null ids hash as the empty string; equal texts
get equal answers; other columns stay out of it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import digest_int, ship, text_batches, worker_cache

REFERENCE = 65_536
PER_LANGUAGE = 64
LANGUAGES = 256
WINDOW = 4096
PREFIX = 96
#: Bits for a byte that a reference doesn't have, beside the phrase that it is.
UNSEEN = 8
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
ASCII_LETTERS = bytes(c | 32 if chr(c).isascii() and chr(c).isalpha() else 32 for c in range(256))


def normalise(text: str) -> bytes:
    """Lower-case letters and marks, runs of anything else as one space, none at the ends."""
    if text.isascii():
        return b" ".join(text.encode().translate(ASCII_LETTERS).split())
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[a-z]", text)) or any(c.isalpha() for c in text.decode())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the empty string. Every path from 0 spells a substring of the text."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for byte in text:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p, last = last, new
        while p >= 0 and byte not in moves[p]:
            moves[p][byte] = new
            p = link[p]
        if p < 0:
            continue
        q = moves[p][byte]
        if longest[q] == longest[p] + 1:
            link[new] = q
            continue
        copy = len(moves)
        moves.append(dict(moves[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        while p >= 0 and moves[p].get(byte) == q:
            moves[p][byte] = copy
            p = link[p]
        link[q] = link[new] = copy
    return moves


class Packed:
    """An automaton's rows laid over each other in one array of slots.

    State s goes on with symbol c where ``owner[base[s] + c]`` is s, and ``target`` says to which state. Rows with
    several symbols are fitted into the slots near the end, those with many first; rows with one symbol, which are
    most, then fill the gaps.
    """

    def __init__(self, moves: list[dict[int, int]], symbol: np.ndarray, width: int) -> None:
        self.base = np.zeros(len(moves), np.int32)
        rows = [{int(symbol[b]): to for b, to in out.items()} for out in moves]
        several = sorted((s for s, row in enumerate(rows) if len(row) > 1), key=lambda s: -len(rows[s]))
        taken, begin = 0, width  # the bits of ``taken`` are the slots from ``begin`` on
        slots, owners, targets = [], [], []
        for state in several:
            least = min(rows[state])
            bits = sum(1 << (c - least) for c in rows[state])
            at = 0
            while taken & (bits << at):
                at += 1
            base = begin + at - least
            self.base[state] = base
            for c, to in rows[state].items():
                slots.append(base + c)
                owners.append(state)
                targets.append(to)
            taken |= bits << at
            if at > width:
                taken, begin = taken >> width, begin + width
            while taken & 1:
                taken, begin = taken >> 1, begin + 1
        single = np.array([(s, *next(iter(row.items()))) for s, row in enumerate(rows) if len(row) == 1], np.int64).reshape(-1, 3)
        end = max(slots, default=width) + 1
        self.owner, self.target = np.full(end + len(single) + width, -1, np.int32), np.zeros(end + len(single) + width, np.int32)
        self.owner[slots], self.target[slots] = owners, targets
        gaps = width + np.flatnonzero(self.owner[width:] < 0)[: len(single)]
        self.owner[gaps], self.target[gaps] = single[:, 0], single[:, 2]
        self.base[single[:, 0]] = gaps - single[:, 1]
        used = max(end, int(gaps.max(initial=0)) + 1) + width
        self.owner, self.target = self.owner[:used].copy(), self.target[:used].copy()


class Parser:
    """The automata of all languages, one after the other in the same arrays."""

    def __init__(self, references: dict[str, bytes]) -> None:
        self.languages = sorted(references)
        used = sorted(set(b"".join(references.values())))
        self.symbol = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)  # 0: a byte that no reference has
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        bases, owners, targets, roots, firsts = [], [], [], [], []
        states = slots = 0
        for language in self.languages:
            moves = suffix_automaton(references[language])
            packed = Packed(moves, self.symbol, self.width)
            first = np.full(self.width, states, np.int32)
            for byte, to in moves[0].items():
                first[self.symbol[byte]] = states + to
            bases.append(packed.base + np.int32(slots))
            owners.append(np.where(packed.owner < 0, -1, packed.owner + states).astype(np.int32))
            targets.append(packed.target + np.int32(states))
            roots.append(states)
            firsts.append(first)
            states += len(moves)
            slots += len(packed.owner)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.base, self.owner, self.target = join(bases), join(owners), join(targets)
        # No state owns its root's slots, so that a phrase is counted where it begins.
        self.roots = np.array(roots, np.int32)
        self.owner[np.isin(self.owner, self.roots)] = -1
        self.first = np.stack(firsts) if firsts else np.zeros((0, self.width), np.int32)
        lengths = [len(references[x]) for x in self.languages]
        self.bits = math.log2(max(lengths, default=0) + 1)
        self.order = np.array(sorted(range(len(lengths)), key=lambda i: (lengths[i], i)), np.int64)
        self.lacks = np.array([[byte not in references[x] for x in self.languages] for byte in range(256)], np.int64).reshape(256, -1)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.base, self.owner, self.target, self.first, self.lacks))

    def walk(self, symbols: list[np.ndarray], state: np.ndarray, start: int = 0, stop: int = WINDOW) -> np.ndarray:
        """Read the bytes from ``start`` to ``stop`` of each stretch; ``state[language, stretch]`` moves along.

        The phrases that begin, by language and stretch. Longer stretches must come first.
        """
        lengths = np.array([min(len(s), stop) for s in symbols])
        found = np.zeros(state.shape, np.int32)
        if not len(symbols) or lengths[0] <= start:
            return found
        columns = np.zeros((lengths[0] - start, len(symbols)), self.symbol.dtype)
        for row, s in enumerate(symbols):
            own = s[start : lengths[row]]
            columns[: len(own), row] = own
        active = np.searchsorted(-lengths, -np.arange(start, lengths[0]), "left").tolist()
        for column, n in zip(columns, active, strict=True):
            c, now = column[:n], state[:, :n]
            at = self.base.take(now)
            at += c
            goes = self.owner.take(at) == now
            state[:, :n] = np.where(goes, self.target.take(at), self.first[:, c])
            found[:, :n] += ~goes
        return found

    def phrases(self, texts: list[bytes], window: int = WINDOW, prefix: int = PREFIX) -> np.ndarray:
        """phrases[text, language] of each whole text."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        stretches = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), window)]
        follows = np.array([at > 0 for _, at in stretches], bool)
        symbols = [self.symbol[np.frombuffer(texts[i], np.uint8, min(window, len(texts[i]) - at), at)] for i, at in stretches]
        n, k = len(stretches), len(self.languages)
        ends = np.zeros((k, n), np.int32)
        counts, heads, middles = np.zeros((k, n), np.int32), np.zeros((k, n), np.int32), np.zeros((k, n), np.int32)
        enters = np.repeat(self.roots[:, None], n, axis=1)

        def read(some: np.ndarray, entering: np.ndarray) -> None:
            """Read stretches from the states entering them; longer ones first, so many at a time."""
            some = some[np.argsort([-len(symbols[s]) for s in some], kind="stable")]
            for low in range(0, len(some), 2048):
                part = some[low : low + 2048]
                own, state = [symbols[s] for s in part], np.ascontiguousarray(entering[:, part])
                heads[:, part] = self.walk(own, state, 0, prefix)
                middles[:, part] = state
                counts[:, part] = heads[:, part] + self.walk(own, state, prefix, window)
                ends[:, part] = state

        read(np.arange(n), enters)
        todo = np.flatnonzero(follows)
        while len(todo):
            before = ends[:, todo - 1]
            changed = (before != enters[:, todo]).any(axis=0)
            todo = todo[changed]
            if not len(todo):
                break
            enters[:, todo] = ends[:, todo - 1]
            todo = todo[np.argsort([-len(symbols[s]) for s in todo], kind="stable")]
            state = np.ascontiguousarray(enters[:, todo])
            own = [symbols[s] for s in todo]
            head = self.walk(own, state, 0, prefix)
            meet = (state == middles[:, todo]).all(axis=0)
            met = todo[meet]
            counts[:, met] += head[:, meet] - heads[:, met]
            heads[:, met] = head[:, meet]
            read(todo[~meet], enters)
            todo = np.sort(np.flatnonzero(follows))
        np.add.at(out, [i for i, _ in stretches], counts.T)
        return out

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """bits[text, language]."""
        bytes_of = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts], np.int64).reshape(-1, 256)
        return self.phrases(texts) * self.bits + bytes_of @ self.lacks * UNSEEN

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [normalise(t) if t is not None else b"" for t in texts]
        known = [bool(self.languages) and has_letter(t) for t in plain]
        rates = self.costs([t if k else b"" for t, k in zip(plain, known, strict=True)])
        languages, scores = [], []
        for row, ok in zip(rates, known, strict=True):
            if not ok:
                languages.append("und")
                scores.append(0.0)
                continue
            best = int(self.order[row[self.order].argmin()])
            languages.append(self.languages[best])
            rest = np.delete(row, best)
            scores.append(float(rest.min() / (row[best] + rest.min())) if len(rest) else 1.0)
        return languages, scores


def gather_references(labelled: DataFrame, reference: int = REFERENCE, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> dict[str, bytes]:
    """The reference of each language of ``labelled`` (doc_id, text, lang), of whole texts."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    teach = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col("lang").cast("string").alias("_lang"), digest_int(F.concat(F.lit("language:"), key)).alias("_draw"), F.col("text").cast("string").alias("_text")
    )
    # Numbers alone first, combined before they move, whatever a language's share of the rows is.
    seen = teach.withColumn("_bytes", F.octet_length("_text")).groupBy("_lang", F.pmod("_draw", F.lit(per_language)).alias("_bucket"))
    seen = seen.agg(F.min(F.struct("_draw", "_bytes")).alias("_least"), F.count("*").alias("_rows")).select("_lang", "_least.*", "_rows")
    most = seen.groupBy("_lang").agg(F.sum("_rows").alias("_all")).orderBy(F.col("_all").desc(), "_lang").limit(languages)
    rows = seen.join(F.broadcast(most), "_lang").orderBy("_lang", "_draw").collect()  # languages * per_language rows at most
    chosen: dict[str, list[tuple[int, int]]] = {}
    held: dict[str, int] = {}
    for r in rows:
        if held.get(r["_lang"], 0) + r["_bytes"] + 1 <= reference:
            chosen.setdefault(r["_lang"], []).append((r["_draw"], r["_bytes"]))
            held[r["_lang"]] = held.get(r["_lang"], 0) + r["_bytes"] + 1
    for r in sorted(rows, key=lambda r: (r["_bytes"], r["_draw"])):
        chosen.setdefault(r["_lang"], [(r["_draw"], r["_bytes"])])
    if not chosen:
        return {}
    wanted = labelled.sparkSession.createDataFrame([(x, d, b) for x, pairs in chosen.items() for d, b in pairs], "_lang string, _draw long, _bytes int")
    texts = teach.join(F.broadcast(wanted.withColumnRenamed("_bytes", "_want")), ["_lang", "_draw"]).filter(F.octet_length("_text") == F.col("_want"))
    texts = texts.groupBy("_lang", "_draw").agg(F.min("_text").alias("_text"))
    out: dict[str, bytes] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["_lang"], r["_draw"])):
        out[r["_lang"]] = (out[r["_lang"]] + b" " if r["_lang"] in out else b"") + normalise(r["_text"])
    return out


def fit(labelled: DataFrame, **limits: int) -> dict[str, bytes]:
    """The model: the languages' references, from which each worker builds its automata."""
    return gather_references(labelled, **limits)


def parser_of(references: dict[str, bytes]) -> Parser:
    """The automata of these references, built once for each Python worker, which keeps those used last."""
    held: dict[str, Parser] = worker_cache("automata", dict)
    name = hashlib.blake2b(repr(sorted(references.items())).encode(), digest_size=16).hexdigest()
    if name not in held:
        held.clear()
        held[name] = Parser(references)
    return held[name]


def _parts(texts: list[str | None], most: int = 1024, characters: int = 4 << 20) -> Iterator[list[str | None]]:
    """The texts in turn, so many of them or so many characters at a time, one text at least."""
    part, held = [], 0
    for text in texts:
        if part and (len(part) == most or held + len(text or "") > characters):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text or "")
    if part:
        yield part


def predict(docs: DataFrame, references: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from its texts alone."""
    model = ship(docs.sparkSession, references)
    text_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = parser_of(model())
        for texts in batches:
            languages: list[str] = []
            scores: list[float] = []
            for some in _parts(texts.tolist()):
                judged = own.judge(some)
                languages += judged[0]
                scores += judged[1]
            yield pd.DataFrame({"lang_pred": languages, "score": scores})

    judged = docs.withColumn("_judged", judge(F.col(text).cast("string")))
    return judged.select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "_judged.lang_pred", "_judged.score")


def held_out(doc_id: Column) -> Column:
    """One in four documents, by the CRC-32 of the id's decimal text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2
