"""SentencePiece BPE by a prefix table.

The encoding of a string by merges fixes the encoding of each of its prefixes' *last* token: token
``t`` is last in the prefix ending at ``i`` exactly if the last token ``u`` of the prefix before ``t``
and ``t`` stay apart when ``u + t`` is encoded alone. So one pass of an automaton over the text,
which lists the pieces that end at each position, and one test of a pair per piece give all last
tokens; the ids are then read backwards. Cost is linear in the length, also for a word of a million letters.

A piece never holds a word mark behind another letter, so words are encoded one by one and recent words remembered.

Defined results: null text counts as empty; empty text has no tokens but the end id; rows are handled one
by one, so repeated rows and ids give repeated rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vacantia.llm.common import Memo, keyed, ship, slices

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def read_vocabulary(path: str) -> dict:
    """Pieces, scores and kinds of a SentencePiece BPE model; about a megabyte, whatever the corpus."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [("byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "piece") for i in range(sp.get_piece_size())]
    return {"pieces": [sp.id_to_piece(i) for i in range(sp.get_piece_size())], "scores": [sp.get_score(i) for i in range(sp.get_piece_size())], "kinds": kinds, "end": sp.eos_id()}


class Encoder:
    def __init__(self, vocabulary: dict, words: int = 100_000, pairs: int = 100_000) -> None:
        self.pieces, self.end = vocabulary["pieces"], vocabulary["end"]
        kinds = vocabulary["kinds"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == "piece"}
        # A better score merges earlier; the lower number is the better one.
        order = sorted(self.ids.values(), key=lambda i: (-vocabulary["scores"][i], i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == "byte"}
        self.value = {i: bytes([b]) for b, i in self.byte.items()}
        self.text = {i: p.replace(MARK, " ") for p, i in self.ids.items()}
        self.made = {i: -1 if len(p) == 1 else r for (p, i), r in zip(self.ids.items(), map(self.rank.get, self.ids.values()), strict=True)}
        self.left, self.right, self.odd = {}, {}, set()
        self.automaton = ahocorasick.Automaton()
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(p) > 1:
                parts = self.merged(p, last=True)
                if len(parts) != 2:
                    continue  # no run of merges makes this piece
                self.left[i], self.right[i] = parts
                if max(map(self.made.get, parts)) > self.made[i] or self.odd.intersection(parts):
                    self.odd.add(i)
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.apart = Memo(self._apart, pairs)
        self.word = Memo(self._word, words)

    def merged(self, s: str, last: bool = False) -> list[int]:
        """Ids of a short string of known letters by merging the best neighbours, the leftmost of equals first; ``last``: before the merge into one."""
        parts = list(s)
        while len(parts) > (2 if last else 1):
            best, at = len(self.rank), -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.rank[i] < best:
                    best, at = self.rank[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _apart(self, pair: int) -> bool:
        """Whether two tokens stay apart. Going back in time from the finished tokens, the parts at the border
        must never have been able to merge before one of them was itself merged into something larger."""
        a, b = divmod(pair, len(self.pieces))
        if a in self.odd or b in self.odd:  # a part merges later than its whole could: play the merges
            return self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        ids, pieces, made, until = self.ids, self.pieces, self.made, len(self.pieces)
        while True:
            i = ids.get(pieces[a] + pieces[b])
            if i is not None and self.rank[i] < until:
                return False
            if made[a] > made[b]:
                until, a = made[a], self.right[a]
            elif made[b] >= 0:
                until, b = made[b] + 1, self.left[b]
            else:
                return True

    def last_tokens(self, word: str) -> list[tuple[int, int] | None]:
        """At each position the (length, id) of the last token of the prefix that ends there; ``None`` for an unknown letter."""
        last: list[tuple[int, int] | None] = [None] * len(word)
        apart, done, n = self.apart, -1, len(self.pieces)
        for end, token in self.automaton.iter(word):
            if end == done:
                continue
            before = end - token[0]
            u = last[before] if before >= 0 else None
            if u is None or apart[u[1] * n + token[1]]:
                last[end], done = token, end
        return last

    def encode_word(self, word: str) -> list[int]:
        last, out, at = self.last_tokens(word), [], len(word) - 1
        while at >= 0:
            token = last[at]
            if token is None:
                out.extend(self.byte[b] for b in reversed(word[at].encode()))
                at -= 1
            else:
                out.append(token[1])
                at -= token[0]
        return out[::-1]

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word)
        return array("i", ids).tobytes(), self._decoded(ids)

    def words(self, text: str) -> list[tuple[bytes, str]]:
        return list(map(self.word.__getitem__, WORD.findall(MARK + text.replace(" ", MARK)))) if text else []

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        return [*np.frombuffer(b"".join(w[0] for w in self.words(text or "")), np.int32).tolist(), *([self.end] if end else [])]

    def _decoded(self, ids: list[int]) -> str:
        if not any(map(self.value.__contains__, ids)):
            return "".join([self.text.get(i, "") for i in ids])
        out, run = [], b""
        for i in ids:
            if i in self.value:
                run += self.value[i]
                continue
            if run:
                out.append(_utf8(run))
                run = b""
            out.append(self.text.get(i, ""))
        return "".join(out) + (_utf8(run) if run else "")

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; control ids are silent, the mark put before the text is taken away, bytes that are no UTF-8 become U+FFFD."""
        ids = list(ids)
        text = self._decoded(ids)
        return text.removeprefix(" ") if next((i in self.text for i in ids if i in self.text or i in self.value), False) else text


def _utf8(run: bytes) -> str:
    """Like a decoder that replaces each wrong byte by itself."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_encoders: dict[int, Encoder] = {}


def _encoder(key: int, vocabulary: dict) -> Encoder:
    """One per worker process, so that its memory of words lasts over tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode_decode(df: DataFrame, vocabulary: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (with the end id) and ``decoded`` of every row."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)  # a tokenizer's vocabulary, not data
    key = zlib.crc32("\n".join(f"{p} {s}" for p, s in zip(vocabulary["pieces"], vocabulary["scores"], strict=True)).encode())
    rows = keyed(df, id_col, text_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, shared.value)
        end = np.int32(enc.end).tobytes()
        for b in slices(batches):
            ids, offsets, texts = [], [0], []
            for text in b.column(1).to_pylist():
                words = enc.words(text or "")
                one = b"".join([w[0] for w in words])
                ids.append(one)
                ids.append(end)
                offsets.append(offsets[-1] + len(one) // 4 + 1)
                texts.append("".join([w[1] for w in words]).removeprefix(" "))
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
