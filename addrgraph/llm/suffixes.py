"""Removal of repeated byte strings by sharded suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with
a smaller id.  Suffix arrays of everything would move every byte many times, so strings are
first brought together by content:

1. Every string of ``length`` bytes picks an anchor inside it (its ``gram`` bytes with the
   least hash, the leftmost of equals), so equal strings pick equal anchors.  Neighbouring
   strings mostly pick the same one: an anchor stands for a segment of strings.
2. Anchors that occur in one document only are dropped; the others' segments go to the
   shard of their anchor, equal segments of a chunk of documents once.  An anchor with more
   segments than a shard takes is divided: its strings go out one by one, each to the shard
   of its own hash, so a string comes once from a chunk, however many documents have it.
3. A shard whose segments of an anchor differ is sorted: prefix doubling gives its suffix
   array, the permuted longest common prefixes tell which strings are equal, and each
   string's smallest document goes back to the chunks.

Documents stand in chunks of bounded size, which are written once and joined by chunk.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrgraph.session import bucketed_table

from .common import read, text_or_empty, written

TAGGED = "chunk long, kind int, bucket long, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary"
NAMES = ["chunk", "kind", "bucket", "b0", "b1", "b2", "b3", "b4"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
NO_ID = 2**63 - 1  # a null id: no document's id is larger
TABLE = np.random.default_rng(50).integers(0, 2**32, 256, dtype=np.uint32)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (whole numbers above 0) in order, by prefix doubling: places
    that agree in their first letters stand in one group, and only groups of several are sorted on,
    by the group of the place as many letters further."""
    text = np.asarray(text, np.int64)
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    letter = np.cumsum(np.bincount(text) > 0)[text].astype(np.uint64)  # 1, 2, ...; 0 stands past the end
    bits = int(letter.max()).bit_length()
    same = 64 // bits
    letter = np.append(letter, np.zeros(same, np.uint64))
    word = letter[:n].copy()
    for k in range(1, same):
        word <<= np.uint64(bits)
        word |= letter[k:n + k]
    sa = np.argsort(word)
    word = word[sa]
    new = np.append(True, word[1:] != word[:-1])
    place = np.arange(n)  # of the groups that are still open
    group = np.zeros(n + 1, np.int64)  # place of a group's first, from 1
    own = sa
    while True:
        group[own] = np.maximum.accumulate(np.where(new, place, 0)) + 1
        several = ~(new & np.append(new[1:], True))
        place = place[several]
        if not len(place):
            return sa
        own = sa[place]
        key = group[own] * (n + 1) + group[np.minimum(own + same, n)]
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[place] = own
        new = np.append(True, key[1:] != key[:-1])
        same *= 2


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int | None = None) -> np.ndarray:
    """For every place of the text (letters from 1 to 65 535), how many letters, up to ``most``,
    its suffix shares with the one before it in order; all places step on four letters at a time."""
    n = len(text)
    out = np.zeros(n, np.int64)
    letters = np.zeros(n + 4, np.uint64)
    letters[:n] = text
    four = sum(letters[k:n + 1 + k] << np.uint64(16 * k) for k in range(4))
    place, before, same = sa[1:], sa[:-1], 0
    while len(place) and (most is None or same < most):
        # past the end stands 0, where no two places come together
        unlike = four[np.minimum(place + same, n)] ^ four[np.minimum(before + same, n)]
        fits = unlike == 0
        last = unlike[~fits]
        out[place[~fits]] = same + sum((last & np.uint64((1 << 16 * k) - 1)) == 0 for k in (1, 2, 3))
        place, before = place[fits], before[fits]
        same += 4
        out[place] = same
    return out if most is None else np.minimum(out, most)


def smallest_owner(segments: list[bytes], owners: list[int], length: int) -> tuple[np.ndarray, ...]:
    """For every string of ``length`` bytes of every segment, the smallest owner of an equal one:
    runs of neighbours with the same, as number of the segment, first string, strings, owner."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1  # smaller than any letter
    owner = np.repeat(np.array(owners, np.int64), sizes + 1)
    starts_one = np.repeat(ends, sizes + 1) - np.arange(len(text)) >= length
    sa = suffix_array(text)
    joined = (permuted_prefixes(text, sa, length)[sa] >= length) & starts_one[sa]
    begin = np.flatnonzero(~joined)
    least = np.minimum.reduceat(owner[sa], begin)
    result = np.empty(len(text), np.int64)
    result[sa] = np.repeat(least, np.diff(np.append(begin, len(sa))))
    # a run ends where the next begins, or with its segment's strings
    opens = starts_one.copy()
    opens[1:] &= ~starts_one[:-1] | (result[1:] != result[:-1])
    edges = np.flatnonzero(opens | ~starts_one)
    at = np.flatnonzero(opens[edges])
    first = edges[at]
    segment = np.searchsorted(ends, first)
    return segment, first - (ends - sizes)[segment], edges[at + 1] - first, result[first]


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _picked(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For every string of ``length`` bytes of ``data``, where its anchor stands."""
    # rolling hash of ``gram`` bytes by doubling
    h, have, total, done = TABLE[data], 1, None, 0
    while True:
        if gram & have:
            if total is None:
                total = h
            else:
                m = min(len(total), len(h) - done) if len(h) > done else 0
                total = total[:m] * np.uint32(pow(0x01000193, have, 2**32)) + h[done:done + m]
            done += have
        if done == gram:
            break
        h = h[:-have] * np.uint32(pow(0x01000193, have, 2**32)) + h[have:]
        have *= 2
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    total ^= total >> np.uint32(13)
    key = (total.astype(np.uint64) << np.uint64(32)) | np.arange(len(total), dtype=np.uint64)
    # least key of every window of grams
    window, span = length - gram + 1, 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[:len(key) - (window - span)], key[window - span:])
    return key.astype(np.uint32)  # the low half


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int, block: int = 1 << 15):
    """Segments of the texts that stand one after the other in ``data``: hash of the anchor,
    first and last string start, text number, and the anchor's place; every string of
    ``length`` bytes within a text is in one segment.  Anchors are picked for ``block`` strings
    at a time, which a processor's cache holds."""
    none = np.empty(0, np.int64)
    n = len(data)
    if n < length:
        return none.view(np.uint64), none, none, none, none
    picked = np.concatenate([_picked(data[a:a + block + length - 1], length, gram) + np.uint32(a) for a in range(0, n - length + 1, block)])
    # a segment begins with its text or where another anchor is picked, and ends before the next or with the text's strings
    some = np.flatnonzero(sizes >= length)
    if not len(some):
        return none.view(np.uint64), none, none, none, none
    until = np.cumsum(sizes)[some] - length + 1
    begin = until - sizes[some] + length - 1
    first = np.flatnonzero(picked[1:] != picked[:-1]) + 1
    of = np.searchsorted(begin, first, "right") - 1
    first = first[(of >= 0) & (first < until[of])]
    marked = np.zeros(len(picked), bool)
    marked[first] = True
    marked[begin] = True
    first = np.flatnonzero(marked)
    of = np.searchsorted(begin, first, "right") - 1
    last = np.minimum(np.append(first[1:], n), until[of]) - 1
    place = picked[first].astype(np.int64)
    # the gram's bytes eight at a time, the last ones filled up with zeros
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    hashed = np.zeros(len(first), np.uint64)
    for at in range(0, gram, 8):
        column = eight[place + at]
        if gram - at < 8:
            column &= np.uint64((1 << 8 * (gram - at)) - 1)
        hashed = _mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + column)
    return hashed, first, last, some[of], place


def _tagged(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, KINDS)], names=NAMES)


def _chunked(chunk_bytes: int):
    """Documents in the order they come, together up to ``chunk_bytes``; a longer one alone."""
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress

        def chunk(own):
            rows, ids, texts = zip(*own)
            sizes = np.array([len(t) for t in texts], np.int64)
            return (rows[0], 0, int(sizes.sum()), pack(b"".join(texts)), sizes.tobytes(), np.array(rows, np.int64).tobytes(),
                    np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(), None)

        own, size = [], 0
        for b in batches:
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_buffer().to_pybytes()
                if own and size + len(text) > chunk_bytes:
                    yield from _tagged([chunk(own)]).to_batches()
                    own, size = [], 0
                own.append((row, doc_id, text))
                size += len(text)
        if own:
            yield from _tagged([chunk(own)]).to_batches()

    return run


def _opened(b0, b1, b2, b3):
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(b0), np.uint8)
    return data, *(np.frombuffer(x, np.int64) for x in (b1, b2, b3))


def _sorted_by_bucket(hashed: np.ndarray, bits: int):
    """(bucket, slice) of hashes in order."""
    buckets = (hashed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashed), np.int64)
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else []
    return [(int(buckets[a]), slice(int(a), int(e))) for a, e in zip(starts, [*starts[1:], len(buckets)])]


def _packed_marks(cut: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """47 bits of each hash and a flag, six bytes each; equal cuts of unequal hashes only
    send a segment that nothing equals."""
    return np.ascontiguousarray(((cut << np.uint64(1)) | flag.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :6])


def _marks(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _list_anchors(bits: int, length: int, gram: int):
    """Distinct anchors of each chunk by bucket; the lowest bit says: in several of its documents.
    Of anchors that occur again in the chunk the place in the list, and how often again."""
    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                data, sizes, _, ids = _opened(*row[3:7])
                hashed, _, _, doc, _ = anchors(data, sizes, length, gram)
                order = np.lexsort((ids[doc], hashed))
                hashed, doc = hashed[order], ids[doc[order]]
                begin = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(hashed) else np.empty(0, np.int64)
                several = doc[begin] != doc[np.append(begin[1:], len(doc)) - 1] if len(begin) else np.empty(0, bool)
                again = np.diff(np.append(begin, len(hashed))) - 1
                hashed = hashed[begin]
                packed = _packed_marks(hashed >> np.uint64(17), several)
                yield from _tagged([(row[0], 1, bucket, packed[at].tobytes(),
                                     np.stack([np.flatnonzero(again[at]), again[at][again[at] > 0]]).tobytes(), None, None, None)
                                    for bucket, at in _sorted_by_bucket(hashed, bits)]).to_batches()

    return run


def _shared_anchors(most: int):
    """The anchors of a bucket that several documents have, for each chunk; the lowest bit says: more than
    ``most`` times in all, so divided.  ``bucket`` is how often the chunk has such anchors."""
    def run(bucket: pa.Table) -> pa.Table:
        lists = [_marks(x) for x in bucket["b0"].to_pylist()]
        ends = np.cumsum([len(x) for x in lists])
        times = np.ones(ends[-1], np.int64)
        for end, x, again in zip(ends, lists, bucket["b1"].to_pylist()):
            place, n = np.frombuffer(again, np.int64).reshape(2, -1)
            times[end - len(x) + place] += n
        marked = np.concatenate(lists)
        every, inverse, n = np.unique(marked >> np.uint64(1), return_inverse=True, return_counts=True)
        several = n > 1
        several[inverse[(marked & np.uint64(1)) == 1]] = True
        total = np.zeros(len(every), np.int64)
        np.add.at(total, inverse, times)
        divided = (several & (total > most))[inverse]
        packed = _packed_marks(every[inverse], divided)
        return _tagged([(chunk, 1, int(t[d].sum()), p[k].tobytes(), None, None, None, None)
                        for chunk, p, k, d, t in zip(bucket["chunk"].to_pylist(), *(np.split(c, ends[:-1]) for c in (
                            packed, several[inverse], divided, times))) if k.any()])

    return run


def _shared_segments(chunk: pa.Table, told: pa.Table, length: int, gram: int):
    """The chunk opened, and of its segments with shared anchors: document, first string, and
    the number of the distinct segment (bytes and the anchor's offset), which are listed by anchor.
    Every string of a divided anchor is a segment, listed by its own hash."""
    whole = chunk.to_pylist()[0]
    data, sizes, rows, ids = _opened(whole["b0"], whole["b1"], whole["b2"], whole["b3"])
    shared = [_marks(x) for x, k in zip(told["b0"].to_pylist(), told["kind"].to_pylist()) if k == 1]
    empty = np.empty(0, np.int64)
    if not shared:
        return data, sizes, rows, ids, empty, empty, empty, []
    hashed, first, last, doc, place = anchors(data, sizes, length, gram)
    shared = np.sort(np.concatenate(shared))
    shared, divided = shared >> np.uint64(1), (shared & np.uint64(1)) == 1
    mark = hashed >> np.uint64(17)
    at = np.minimum(np.searchsorted(shared, mark), len(shared) - 1)
    keep = shared[at] == mark
    divided = divided[at][keep]
    hashed, first, last, doc, place = hashed[keep], first[keep], last[keep], doc[keep], place[keep]
    raw = data.tobytes()
    keys = zip(hashed.tolist(), [raw[a:e] for a, e in zip(first.tolist(), (last + length).tolist())], (place - first).tolist())
    number: dict[tuple[int, bytes, int], int] = {}
    segment = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
    distinct = list(number)
    # by anchor; of one anchor in the order they come, which is the chunk's
    order = np.argsort(np.array([h for h, _, _ in distinct], np.uint64), kind="stable")
    distinct = [distinct[i] for i in order.tolist()]
    renumbered = np.empty(len(order), np.int64)
    renumbered[order] = np.arange(len(order))
    segment = renumbered[segment]
    if not divided.any():
        return data, sizes, rows, ids, doc, first, segment, distinct
    parts = [[k] for k in distinct]
    for i in np.unique(segment[divided]).tolist():
        _, s, o = distinct[i]
        strings = [s[k:k + length] for k in range(len(s) - length + 1)]
        parts[i] = [(int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little"), t, o - k) for k, t in enumerate(strings)]
    distinct = sorted({k for own in parts for k in own})
    number = {k: i for i, k in enumerate(distinct)}
    listed = np.array([number[k] for own in parts for k in own], np.int64)
    n = np.array([len(own) for own in parts], np.int64)
    begin, n = (np.cumsum(n) - n)[segment], n[segment]
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return data, sizes, rows, ids, np.repeat(doc, n), np.repeat(first, n) + shift, listed[np.repeat(begin, n) + shift], distinct


def _send_segments(bits: int, length: int, gram: int):
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        import zstandard

        if not len(chunk) or not len(told):
            return _tagged([])
        _, _, _, ids, doc, _, number, distinct = _shared_segments(chunk, told, length, gram)
        if not distinct:
            return _tagged([])
        pack = zstandard.ZstdCompressor(level=3).compress
        least, most = np.full(len(distinct), NO_ID), np.full(len(distinct), -2**63)
        np.minimum.at(least, number, ids[doc])
        np.maximum.at(most, number, ids[doc])
        hashed = np.array([h for h, _, _ in distinct], np.uint64)
        return _tagged([(chunk["chunk"][0].as_py(), 2, bucket, hashed[at].tobytes(),
                         np.array([(len(s), o) for _, s, o in distinct[at]], np.int32).T.tobytes(),
                         pack(b"".join(s for _, s, _ in distinct[at])), least[at].tobytes(), most[at].tobytes())
                        for bucket, at in _sorted_by_bucket(hashed, bits)])

    return run


def _may_share(own: dict, length: int, gram: int) -> list[bytes]:
    """Segments of one anchor that may have a string in common with another: a string holds
    ``length - gram`` bytes beside the anchor, so at least half of them stand on one side,
    next to it, and are the same there."""
    half = (length - gram + 1) // 2
    met: dict[tuple, list[bytes]] = {}
    for segment, (_, at) in own.items():
        if at >= half:
            met.setdefault((0, segment[at - half:at]), []).append(segment)
        if len(segment) - at - gram >= half:
            met.setdefault((1, segment[at + gram:at + gram + half]), []).append(segment)
    some = list(dict.fromkeys(s for group in met.values() if len(group) > 1 for s in group))
    if len(some) > 12:
        return some
    # few are held against each other: what two share on both sides of the anchor must reach the length
    sides = [(s[:own[s][1]][::-1], s[own[s][1] + gram:]) for s in some]
    keep = set()
    for i, (left, right) in enumerate(sides):
        for j in range(i):
            if not (i in keep and j in keep) and gram + len(commonprefix([left, sides[j][0]])) + len(
                    commonprefix([right, sides[j][1]])) >= length:
                keep |= {i, j}
    return [some[i] for i in sorted(keep)]


def _judge_segments(length: int, gram: int, shard_bytes: int):
    """Per chunk: number of the segment within its bucket, first string, strings, smallest owner."""
    def run(bucket: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sent = bucket.to_pylist()
        number: dict[tuple[int, bytes], int] = {}  # distinct segments of each anchor
        which, offsets = [], []
        for row in sent:
            text = unpack(row["b2"])
            size, offset = np.frombuffer(row["b1"], np.int32).reshape(2, -1)
            end = np.cumsum(size, dtype=np.int64)
            segments = [text[a:e] for a, e in zip((end - size).tolist(), end.tolist())]
            which.append(np.array([number.setdefault(k, len(number)) for k in
                                   zip(np.frombuffer(row["b0"], np.uint64).tolist(), segments)], np.int64))
            offsets.append(offset)
        own, offset = np.concatenate(which), np.concatenate(offsets)
        low, high = (np.frombuffer(b"".join(row[c] for row in sent), np.int64) for c in ("b3", "b4"))
        # of each distinct segment the smallest owner, and a place of the anchor
        order = np.lexsort((offset, low, own))
        order = order[np.append(True, own[order][1:] != own[order][:-1])]
        owner, at = low[order], offset[order]
        anchor = np.fromiter((h for h, _ in number), np.uint64, len(number))
        segments = [s for _, s in number]
        # a segment that shares no string with another has its own smallest owner throughout
        whole = np.ones(len(number), bool)
        runs = []
        shard, size = [], 0

        def sort_shard():
            of, *columns = smallest_owner([segments[i] for i in shard], owner[shard].tolist(), length)
            runs.append((np.array(shard, np.int64)[of], *columns))

        order = np.argsort(anchor, kind="stable")
        begin = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
        end = np.append(begin[1:], len(order))
        several = end - begin > 1
        order = order.tolist()
        for a, e in zip(begin[several].tolist(), end[several].tolist()):
            one = {segments[i]: i for i in order[a:e]}
            some = [one[s] for s in _may_share({s: (owner[i], int(at[i])) for s, i in one.items()}, length, gram)]
            shard += some
            size += sum(len(segments[i]) for i in some)
            if size >= shard_bytes:
                sort_shard()
                whole[shard] = False
                shard, size = [], 0
        if shard:
            sort_shard()
            whole[shard] = False
        alone = np.flatnonzero(whole)
        strings = np.array([len(segments[i]) - length + 1 for i in alone.tolist()], np.int64)
        runs.append((alone, np.zeros(len(alone), np.int64), strings, owner[alone]))
        of, *columns = (np.concatenate(c) for c in zip(*runs))
        order = np.argsort(of, kind="stable")
        of, columns = of[order], [c[order] for c in columns]
        # the runs of every segment that was sent, where another owner than its own is the smallest
        first = np.searchsorted(of, np.arange(len(number) + 1))
        n = np.diff(first)[own]
        entry = np.repeat(np.arange(len(own)), n)
        run_at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)
        found = columns[2][run_at] < high[entry]
        entry, run_at = entry[found], run_at[found]
        ends = np.cumsum([len(w) for w in which])
        cut = np.searchsorted(entry, np.append(0, ends))
        return _tagged([(row["chunk"], 2, row["bucket"], (entry[a:e] - (end - len(w))).tobytes(),
                         *(c[run_at[a:e]].tobytes() for c in columns), None)
                        for row, w, end, a, e in zip(sent, which, ends.tolist(), cut[:-1].tolist(), cut[1:].tolist()) if e > a])

    return run


RESULT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
NAMES_OUT = [c.split()[0] for c in RESULT.split(", ")]
KINDS_OUT = [pa.int64()] * 5 + [pa.string(), pa.binary()]


def _apply(bits: int, length: int, gram: int, with_text: bool):
    def run(chunk: pa.Table, results: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.table([pa.array([], k) for k in KINDS_OUT], names=NAMES_OUT)
        data, sizes, rows, ids, doc, first, number, distinct = _shared_segments(chunk, results, length, gram)
        change = np.zeros(len(data) + 1, np.int32)
        base = dict((bucket, at.start) for bucket, at in _sorted_by_bucket(np.array([h for h, _, _ in distinct], np.uint64), bits))
        told = [np.stack([np.frombuffer(r["b0"], np.int64) + base[r["bucket"]], *(np.frombuffer(r[c], np.int64) for c in ("b1", "b2", "b3"))])
                for r in results.to_pylist() if r["kind"] == 2]
        if told:
            told = np.concatenate(told, axis=1)
            told = told[:, np.argsort(told[0], kind="stable")]
            begin = np.searchsorted(told[0], np.arange(len(distinct) + 1))
            low, n = begin[number], np.diff(begin)[number]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            who = np.repeat(np.arange(len(number)), n)
            goes = told[3][at] < ids[doc[who]]
            begin = first[who[goes]] + told[1][at[goes]]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + told[2][at[goes]] - 1 + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out, end = [], 0
        for row, doc_id, size in zip(rows.tolist(), ids.tolist(), sizes.tolist()):
            own, mask = data[end:end + size], gone[end:end + size]
            end += size
            kept = own[~mask].tobytes()
            spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if size else 0
            out.append((row, None if doc_id == NO_ID else doc_id, size, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(),
                        kept if with_text else None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), KINDS_OUT)], names=NAMES_OUT)

    return run


def drop_repeats(docs: DataFrame, length: int = 50, gram: int = 20, chunk_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20,
                 shard_bytes: int = 1 << 20, with_text: bool = False) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes if ``with_text``), one row per
    row of ``docs``.

    Null texts count as empty; texts shorter than ``length`` lose nothing; of equal ids none
    is smaller, so repeated rows don't remove each other; a null id is larger than any other
    and smaller than none; an empty table gives no row; other columns are ignored.  ``chunk_bytes``,
    ``bucket_bytes`` and ``shard_bytes`` bound what a task holds, not what is found.
    """
    if not 8 <= gram < length:
        raise ValueError("gram must be from 8 to length - 1")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.encode(text_or_empty(docs), "UTF-8").alias("text"))
    # bucketed by chunk: the texts are moved once, and both later passes read them in place
    chunks, name = bucketed_table(slim.mapInArrow(_chunked(chunk_bytes), TAGGED), "llm_chunks", "chunk")
    try:
        total = chunks.agg(F.sum("bucket")).first()[0] or 0
        bits = max(0, int(total // bucket_bytes).bit_length())
        most = shard_bytes // (2 * length - gram)  # longer no segment is
        shared = written(chunks.mapInArrow(_list_anchors(bits, length, gram), TAGGED)
                         .groupBy("bucket").applyInArrow(_shared_anchors(most), TAGGED), "shared")
        total += (shared.agg(F.sum("bucket")).first()[0] or 0) * (length - gram + 1) * length  # strings of divided anchors
        bits = max(0, int(total // bucket_bytes).bit_length())
        judged = written(chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_segments(bits, length, gram), TAGGED)
                         .groupBy("bucket").applyInArrow(_judge_segments(length, gram, shard_bytes), TAGGED), "judged")
        out = written(chunks.groupBy("chunk").cogroup(shared.union(judged).groupBy("chunk"))
                      .applyInArrow(_apply(bits, length, gram, with_text), RESULT), "kept")
    finally:
        docs.sparkSession.sql(f"drop table if exists {name}")
    return out if with_text else out.drop("kept")


def op2_sharded_suffix_arrays(spark, sf_dir):
    return drop_repeats(read(spark, sf_dir, "documents")).drop("row")
