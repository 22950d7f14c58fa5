"""Removal of repeated word passages by sharded Aho-Corasick automata.

A word goes if it lies in a window of ``length`` words that also starts in a document with a
smaller id.  One automaton for all repeated phrases would not fit a task, and streaming every
document past every shard would grow with the square of the corpus, so both are dealt by
content:

1. Every window picks the phrase of ``gram`` words inside it with the least hash (the leftmost
   of equals), so equal windows pick equal phrases; neighbouring windows that pick the same
   one form a stretch.  Phrases of one document only are dropped.
2. The stretches of the other phrases go to the shard of their phrase, equal ones of a chunk
   of documents once.  A phrase with more stretches than a shard takes is divided: of its
   windows those that several documents have go to the shards of their own hashes.
3. A shard confirms recurring passages (runs of windows that a second document has), compiles
   them into an automaton over its words, and streams every stretch through it; what it
   locates goes back to the chunks with the passage's smallest document.

Documents stand in chunks of bounded size, which are written once and joined by chunk.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrgraph.session import bucketed_table, scratch

from .common import read, text_or_empty, written
from .suffixes import (NO_ID, TAGGED, _chunked, _marks, _mixed, _opened, _packed_marks, _shared_anchors, _sorted_by_bucket,
                       _tagged)

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)
ANCHORS, WINDOWS, FOUND = 1, 3, 2


def words_in(data: np.ndarray, sizes: np.ndarray):
    """Begin and end of every word of the texts that stand one after the other in ``data``, its
    hash, and the words of each text."""
    n = len(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    stops = np.cumsum(sizes)
    edge = np.zeros(n + 1, bool)
    edge[stops] = edge[0] = True
    before, after = np.append(True, blank)[:n], np.append(blank[1:], True)[:n]
    begin = np.flatnonzero(~blank & (before | edge[:-1]))
    end = np.flatnonzero(~blank & (after | edge[1:])) + 1
    power = np.full(n + 1, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1]))
    power = np.full(n + 1, UNBASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    hashed = _mixed((total[end] - total[begin]) * power[begin] + (end - begin).astype(np.uint64))
    return begin, end, hashed, np.bincount(np.searchsorted(stops, begin, "right"), minlength=len(sizes))


def _rolled(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbouring words, by doubling."""
    have, out, done, h = 1, None, 0, hashed
    while True:
        if n & have:
            if out is None:
                out = h
            else:
                m = max(0, min(len(out), len(h) - done))
                out = out[:m] * np.uint64(pow(BASE, have, 2**64)) + h[done:done + m]
            done += have
        if done == n:
            return _mixed(out)
        h = h[:-have] * np.uint64(pow(BASE, have, 2**64)) + h[have:] if len(h) > have else h[:0]
        have *= 2


def stretches(hashed: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Phrase's hash, first and last window, and text of every stretch; windows are numbered by
    their first words, and each window that lies within a text is in one stretch."""
    none = np.empty(0, np.int64)
    if len(hashed) < length:
        return none.view(np.uint64), none, none, none
    phrase = _rolled(hashed, gram)
    key = (phrase & ~np.uint64(0xFFFFFFFF)) | np.arange(len(phrase), dtype=np.uint64)
    window, span = length - gram + 1, 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[:len(key) - (window - span)], key[window - span:])
    picked = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    inside = np.zeros(len(picked) + 1, np.int32)
    some = sizes >= length
    np.add.at(inside, (ends - sizes)[some], 1)
    np.add.at(inside, np.minimum(ends - length + 1, len(picked))[some], -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (picked[1:] == picked[:-1]))
    first = np.flatnonzero(new)
    stop = ~valid
    stop[first] = True
    edges = np.append(np.flatnonzero(stop), len(picked))
    last = edges[np.searchsorted(edges, first, "right")] - 1
    return phrase[picked[first]], first, last, np.searchsorted(ends, first, "right")


def _listed(chunk: int, kind: int, hashed: np.ndarray, owner: np.ndarray, bits: int) -> pa.Table:
    """Distinct hashes of a chunk by bucket, whether several of its documents have them, and
    how often they come again."""
    order = np.lexsort((owner, hashed))
    hashed, owner = hashed[order], owner[order]
    begin = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(hashed) else np.empty(0, np.int64)
    until = np.append(begin[1:], len(hashed))
    several = owner[begin] != owner[until - 1] if len(begin) else np.empty(0, bool)
    again, hashed = until - begin - 1, hashed[begin]
    packed = _packed_marks(hashed >> np.uint64(17), several)
    return _tagged([(chunk, kind, bucket, packed[at].tobytes(),
                     np.stack([np.flatnonzero(again[at]), again[at][again[at] > 0]]).tobytes(), None, None, None)
                    for bucket, at in _sorted_by_bucket(hashed, bits)])


def _list_phrases(bits: int, length: int, gram: int):
    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                data, sizes, _, ids = _opened(*row[3:7])
                _, _, hashed, n = words_in(data, sizes)
                phrase, _, _, doc = stretches(hashed, n, length, gram)
                yield from _listed(row[0], ANCHORS, phrase, ids[doc], bits).to_batches()

    return run


def _known(told: pa.Table, kind: int):
    """Marks of one kind that a chunk was told, in order, and their flags."""
    marks = [_marks(x) for x, k in zip(told["b0"].to_pylist(), told["kind"].to_pylist()) if k == kind]
    marks = np.sort(np.concatenate(marks)) if marks else np.empty(0, np.uint64)
    return marks >> np.uint64(1), (marks & np.uint64(1)) == 1


def _among(hashed: np.ndarray, marks: np.ndarray):
    """Which hashes are among the marks, and where."""
    cut = hashed >> np.uint64(17)
    if not len(marks):
        return np.zeros(len(cut), bool), np.zeros(len(cut), np.int64)
    at = np.minimum(np.searchsorted(marks, cut), len(marks) - 1)
    return marks[at] == cut, at


class _Chunk:
    """A chunk opened, with the stretches that other documents may have part of: key, first
    word, number of words and document."""

    def __init__(self, chunk: pa.Table, told: pa.Table, length: int, gram: int):
        whole = chunk.to_pylist()[0]
        self.data, self.sizes, self.rows, self.ids = _opened(whole["b0"], whole["b1"], whole["b2"], whole["b3"])
        self.begin, self.end, hashed, self.n = words_in(self.data, self.sizes)
        phrase, first, last, doc = stretches(hashed, self.n, length, gram)
        marks, divided = _known(told, ANCHORS)
        keep, at = _among(phrase, marks)
        apart = keep & (divided[at] if len(marks) else False)
        whole = keep & ~apart
        # windows of divided phrases, each by its own hash
        count = (last - first + 1)[apart]
        start = np.repeat(first[apart], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.window, self.window_at = (_rolled(hashed, length)[start] if len(start) else np.empty(0, np.uint64)), start
        self.window_doc = np.repeat(doc[apart], count)
        met, _ = _among(self.window, _known(told, WINDOWS)[0])
        self.key = np.concatenate([phrase[whole], self.window[met]])
        self.first = np.concatenate([first[whole], start[met]])
        self.count = np.concatenate([(last - first)[whole] + length, np.full(int(met.sum()), length)])
        self.doc = np.concatenate([doc[whole], self.window_doc[met]])

    def distinct(self):
        """The distinct (key, words) in order, and the number of each stretch."""
        raw = self.data.tobytes()
        keys = [(k, b" ".join(raw[a:e].split())) for k, a, e in zip(
            self.key.tolist(), self.begin[self.first].tolist(), self.end[self.first + self.count - 1].tolist())]
        distinct = sorted(set(keys))
        number = {k: i for i, k in enumerate(distinct)}
        return distinct, np.array([number[k] for k in keys], np.int64)


def _list_windows(bits: int, length: int, gram: int):
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not len(chunk) or not len(told):
            return _tagged([])
        c = _Chunk(chunk, told, length, gram)
        return _listed(chunk["chunk"][0].as_py(), WINDOWS, c.window, c.ids[c.window_doc], bits)

    return run


def _send_stretches(bits: int, length: int, gram: int):
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        import zstandard

        if not len(chunk) or not len(told):
            return _tagged([])
        c = _Chunk(chunk, told, length, gram)
        distinct, number = c.distinct()
        if not distinct:
            return _tagged([])
        pack = zstandard.ZstdCompressor(level=3).compress
        least, most = np.full(len(distinct), NO_ID), np.full(len(distinct), -2**63)
        np.minimum.at(least, number, c.ids[c.doc])
        np.maximum.at(most, number, c.ids[c.doc])
        hashed = np.array([h for h, _ in distinct], np.uint64)
        return _tagged([(chunk["chunk"][0].as_py(), FOUND, bucket, hashed[at].tobytes(), None,
                         pack(b"\n".join(s for _, s in distinct[at])), least[at].tobytes(), most[at].tobytes())
                        for bucket, at in _sorted_by_bucket(hashed, bits)])

    return run


def confirmed(groups: list[dict[str, tuple[int, int]]], length: int) -> dict[str, int]:
    """Recurring passages and their smallest documents.

    A group has the stretches that picked one phrase, as texts with a letter for each word, with
    the smallest and the largest document of each.  A passage is a longest run of windows that
    have the same smallest document and a second one."""
    passages: dict[str, int] = {}

    def add(passage, owner):
        passages[passage] = min(owner, passages.get(passage, owner))

    for group in groups:
        if len(group) == 1:
            ((text, (low, high)),) = group.items()
            if low < high:
                add(text, low)
            continue
        met: dict[str, tuple[int, int]] = {}
        for text, (low, high) in group.items():
            for r in range(len(text) - length + 1):
                w = text[r:r + length]
                a, b = met.get(w, (low, high))
                met[w] = (min(a, low), max(b, high))
        for text in group:
            run, owner = 0, None
            for r in range(len(text) - length + 2):
                a, b = met[text[r:r + length]] if r <= len(text) - length else (None, None)
                now = a if a is not None and a < b else None
                if now != owner:
                    if owner is not None:
                        add(text[run:r + length - 1], owner)
                    run, owner = r, now
    return passages


def located(passages: dict[str, int], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Every occurrence (first word, words, smallest document) of the passages in each text."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for passage, owner in passages.items():
        automaton.add_word(passage, (len(passage), owner))
    if not passages:
        return [[] for _ in texts]
    automaton.make_automaton()
    return [[(end - n + 1, n, owner) for end, (n, owner) in automaton.iter(text)] for text in texts]


def _letter(i: int) -> str:
    return chr(i + 1 if i < 0xD7FF else i + 0x801)  # no surrogates


def _locate(length: int, shard_words: int):
    """Per chunk: number of the stretch within its bucket, first word, words, smallest owner."""
    def run(bucket: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sent = bucket.to_pylist()
        groups: dict[int, dict[bytes, list]] = {}
        for r, row in enumerate(sent):
            columns = (np.frombuffer(row[c], t).tolist() for c, t in (("b0", np.uint64), ("b3", np.int64), ("b4", np.int64)))
            for j, (text, h, low, high) in enumerate(zip(unpack(row["b2"]).split(b"\n"), *columns)):
                own = groups.setdefault(h, {}).setdefault(text, [low, high, []])
                own[0], own[1] = min(own[0], low), max(own[1], high)
                own[2].append((r, j, high))
        out: dict[int, list] = {}

        def shard(some):
            letters: dict[bytes, str] = {}
            texts, asked = [], []
            lettered = []
            for group in some:
                named = {}
                for text, (low, high, entries) in group.items():
                    name = "".join([letters.get(w) or letters.setdefault(w, _letter(len(letters))) for w in text.split(b" ")])
                    named[name] = (low, high)
                    texts.append(name)
                    asked.append(entries)
                lettered.append(named)
            for found, entries in zip(located(confirmed(lettered, length), texts), asked):
                if found:
                    for r, j, high in entries:
                        out.setdefault(r, []).extend((j, at, n, low) for at, n, low in found if low < high)

        some, size = [], 0
        for group in groups.values():
            if len(group) == 1 and (lone := next(iter(group.values())))[0] == lone[1]:
                continue  # one document's
            some.append(group)
            size += sum(t.count(b" ") + 1 for t in group)
            if size >= shard_words:
                shard(some)
                some, size = [], 0
        if some:
            shard(some)
        return _tagged([(sent[r]["chunk"], FOUND, sent[r]["bucket"], *(c.tobytes() for c in np.array(found, np.int64).T), None)
                        for r, found in out.items() if found])

    return run


RESULT = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
NAMES_OUT = [c.split()[0] for c in RESULT.split(", ")]
KINDS_OUT = [pa.int64()] * 4 + [pa.string(), pa.binary()]


def _apply(bits: int, length: int, gram: int, with_text: bool):
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.table([pa.array([], k) for k in KINDS_OUT], names=NAMES_OUT)
        c = _Chunk(chunk, told, length, gram)
        change = np.zeros(len(c.begin) + 1, np.int32)
        found = [r for r in told.to_pylist() if r["kind"] == FOUND]
        if found:
            distinct, number = c.distinct()
            base = dict((b, at.start) for b, at in _sorted_by_bucket(np.array([h for h, _ in distinct], np.uint64), bits))
            spans = np.concatenate([np.stack([np.frombuffer(r["b0"], np.int64) + base[r["bucket"]], *(
                np.frombuffer(r[x], np.int64) for x in ("b1", "b2", "b3"))]) for r in found], axis=1)
            spans = spans[:, np.argsort(spans[0], kind="stable")]
            low, high = np.searchsorted(spans[0], number), np.searchsorted(spans[0], number, "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            who = np.repeat(np.arange(len(number)), n)
            goes = spans[3][at] < c.ids[c.doc[who]]
            begin = c.first[who[goes]] + spans[1][at[goes]]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + spans[2][at[goes]], -1)
        stays = np.cumsum(change[:-1]) <= 0
        raw, out, end, word = c.data.tobytes(), [], 0, 0
        for row, doc_id, size, n in zip(c.rows.tolist(), c.ids.tolist(), c.sizes.tolist(), c.n.tolist()):
            words, mask = raw[end:end + size].split(), stays[word:word + n]
            end, word, left = end + size, word + n, int(mask.sum())
            kept = b" ".join(words if left == n else compress(words, mask.tolist()))
            out.append((row, None if doc_id == NO_ID else doc_id, n, n - left, hashlib.sha256(kept).hexdigest(),
                        kept if with_text else None))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), KINDS_OUT)], names=NAMES_OUT)

    return run


def drop_repeated_passages(docs: DataFrame, length: int = 50, gram: int = 8, chunk_bytes: int = 4 << 20,
                           bucket_bytes: int = 8 << 20, shard_words: int = 400_000, with_text: bool = False) -> DataFrame:
    """row, doc_id, n_words, n_removed, kept_sha256 (and ``kept``, UTF-8, if ``with_text``), one row per row of ``docs``.

    Words are separated by blanks and the characters 09 to 0D and taken unchanged; kept words
    are joined by one blank.  Null texts have no word; texts of fewer than ``length`` words lose
    none; of equal ids none is smaller, so repeated rows don't remove each other; a null id is
    larger than any other and smaller than none; very long texts are a chunk of their own; an
    empty table gives no row; other columns are ignored.  ``chunk_bytes``, ``bucket_bytes`` and
    ``shard_words`` bound what a task holds, not what is found.
    """
    if not 2 <= gram < length:
        raise ValueError("gram must be from 2 to length - 1")
    spark = docs.sparkSession
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.encode(text_or_empty(docs), "UTF-8").alias("text"))
    with scratch(spark, "phrases") as keep:
        # bucketed by chunk: the texts are moved once, and the later passes read them in place
        chunks, name = bucketed_table(slim.mapInArrow(_chunked(chunk_bytes), TAGGED), "llm_phrases", "chunk")
        try:
            by_chunk = lambda told, f: chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(f, TAGGED)
            total = chunks.agg(F.sum("bucket")).first()[0] or 0
            bits = max(0, int(total // bucket_bytes).bit_length())
            most = max(1, shard_words // (2 * length))
            told = written(chunks.mapInArrow(_list_phrases(bits, length, gram), TAGGED)
                           .groupBy("bucket").applyInArrow(_shared_anchors(most), TAGGED), "phrases")
            apart = told.agg(F.sum("bucket")).first()[0] or 0  # stretches of divided phrases
            if apart:
                windows = (by_chunk(told, _list_windows(bits, length, gram)).groupBy("bucket")
                           .applyInArrow(_shared_anchors(2**62), TAGGED).withColumn("kind", F.lit(WINDOWS)))
                told = told.union(written(windows, "windows"))
            found = written(by_chunk(told, _send_stretches(bits, length, gram)).groupBy("bucket")
                            .applyInArrow(_locate(length, shard_words), TAGGED), "found")
            out = keep(chunks.groupBy("chunk").cogroup(told.union(found).groupBy("chunk"))
                       .applyInArrow(_apply(bits, length, gram, with_text), RESULT), "kept")
        finally:
            spark.sql(f"drop table if exists {name}")
    return out if with_text else out.drop("kept")


def op13_phrase_automata(spark, sf_dir):
    return drop_repeated_passages(read(spark, sf_dir, "documents")).drop("row")


ORACLE_OP13 = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as words from documents
), p as (
  select doc_id, len(words) as n, words, unnest(range(1, len(words) + 1)) as pos from w
), g as (
  select doc_id, n, pos, words[pos] as word,
    case when pos + 49 <= n then sha256(array_to_string(words[pos:pos + 49], ' ')) end as win from p
), o as (
  select *, case when win is not null and min(doc_id) over (partition by win) < doc_id then pos end as bad from g
), c as (
  select doc_id, n, pos, word, max(bad) over (partition by doc_id order by pos rows between 49 preceding and current row) is not null as gone from o
)
select w.doc_id, len(words) as n_words, count(*) filter (where gone) as n_removed,
  sha256(coalesce(string_agg(c.word, ' ' order by c.pos) filter (where not gone), '')) as kept_sha256
from w left join c on c.doc_id = w.doc_id group by w.doc_id, words
"""
