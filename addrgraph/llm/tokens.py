"""Token ids and counts of a byte-level BPE vocabulary file, piece by piece.

Words of such vocabularies never reach over a blank that follows a non-blank
character, so a text is cut there and each distinct piece is encoded once per
worker and remembered; a text whose cuts would not be safe (blanks in a row, a
piece that ends in white space, a NUL) is encoded whole.  Ids of pieces that a
full memory doesn't hold are made a text at a time, in one call.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types


#: What ``str.isspace`` holds for white space.
WHITE = "".join(filter(str.isspace, map(chr, range(1 << 16))))


class _Whole(Exception):
    """This text must be encoded whole."""


class _Pieces(dict):
    def __init__(self, encode, limit):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece):
        if not piece or piece[-1].isspace():
            raise _Whole
        if len(self) >= self.limit:
            self.clear()
        value = self[piece] = self.encode(piece)
        return value


def _merge_ranks(path: str):
    """Byte string to id of a byte-level BPE file whose ids follow its merges; else None."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    if model.get("type") not in ("BPE", None) or model.get("byte_fallback") or model.get("end_of_word_suffix"):
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if merged != sorted(merged) or -1 in merged:
        return None
    return {bytes(chars[c] for c in w): i for w, i in model["vocab"].items() if all(c in chars for c in w)}


class TextEncoder:
    """``ids(text)`` as little-endian unsigned 32-bit bytes and ``count(text)``, equal to
    the ``tokenizers`` library's on the file at ``path`` without added special tokens.

    ``merges="library"`` encodes new pieces with ``tokenizers``; ``"ranks"`` merges them with
    ``tiktoken`` over the same file's vocabulary (same ids, a third of the time) and leaves
    pieces that may hold a special token to the library.
    """

    def __init__(self, path: str, merges: str = "library", limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        new, ranks = self._whole, _merge_ranks(path) if merges == "ranks" else None
        self._plain = None
        if ranks:
            import public_tokenizers
            import tiktoken

            special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={}).encode_ordinary
            new = lambda piece: self._whole(piece) if any(s in piece for s in special) else plain(piece)
            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            sizes[list(ranks.values())] = [len(w) for w in ranks]

            def apart(pieces: list[str]) -> list[bytes]:
                """Ids of each piece, made in one call: every piece but a text's first begins with the blank it was cut at."""
                text = "".join(pieces)
                if any(s in text for s in special):
                    return [self._pack(new(piece)) for piece in pieces]
                ids = np.array(plain(text), "<u4")
                upto = np.cumsum(list(map(len, pieces if text.isascii() else [p.encode() for p in pieces])))
                ends = np.searchsorted(np.cumsum(sizes[ids]), upto) + 1
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                return [raw[a:e] for a, e in zip([0, *ends], ends)]

            self._plain = apart
        self._pack = lambda ids: np.array(ids, "<u4").tobytes()
        self._ids = _Pieces(lambda piece: self._pack(new(piece)), limit)
        self._counts = _Pieces(lambda piece: len(new(piece)), limit)

    def _cut(self, text: str):
        if "\x00" in text:
            raise _Whole
        return text.replace(" ", "\x00 ").split("\x00")

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            pieces = self._cut(text)
            if self._plain is None:
                return b"".join(map(self._ids.__getitem__, pieces))
            found = list(map(self._ids.get, pieces))
            new = [i for i, ids in enumerate(found) if ids is None]
            room = max(0, self._ids.limit - len(self._ids))
            for i in new[:room]:
                found[i] = self._ids[pieces[i]]
            if len(new) <= room:
                return b"".join(found)
            if pieces[0] == "" or text[-1] in WHITE or any(w + " " in text for w in WHITE):
                raise _Whole
            for at in range(room, len(new), 10_000):
                own = new[at:at + 10_000]
                for i, ids in zip(own, self._plain([pieces[i] for i in own])):
                    found[i] = ids
            return b"".join(found)
        except _Whole:
            return self._pack(self._whole(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        try:
            return sum(map(self._counts.__getitem__, self._cut(text)))
        except _Whole:
            return len(self._whole(text))


def encoder(path: str, merges: str, limit: int = 800_000) -> TextEncoder:
    """One encoder per worker process, so what it remembers serves all its tasks; it remembers
    at most ``limit`` pieces, about 200 bytes each."""
    kept = sys.modules.setdefault("addrgraph_worker_state", types.ModuleType("addrgraph_worker_state")).__dict__
    if (path, merges, limit) not in kept:
        kept[path, merges, limit] = TextEncoder(path, merges, limit)
    return kept[path, merges, limit]


def file_digest(path: str) -> str:
    """The tokenizer's version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
