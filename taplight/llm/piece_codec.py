"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

``PieceCodec`` finds, with one Aho-Corasick pass, the longest piece that starts at each character.  Encoding takes the
longest piece, keeps it if it is compatible with the piece before it -- re-merging the two pieces' text gives just
these two -- and else tries the next shorter piece; a bitfield remembers positions from which no compatible end was
found, so that none is entered twice.  A sequence whose neighbours are all compatible is the one that merging gives.

Texts fall apart before each run of spaces, for no piece holds a space after another character (the codec checks its
vocabulary for that), so words are encoded once and kept in a bounded table.  Runs of several spaces merge by pieces of
one equal score, where neighbours alone don't settle the order; such a word is merged directly.

Defined results: a null or empty text has the end id alone and decodes to the empty text; repeated rows are kept; a
text of any length is encoded whole.  The vocabulary's path is a parameter; its size bounds what each worker holds.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from taplight.llm.common import holds_tables, id_and_text, small_batches, table

SPACE = "▁"
#: Words kept encoded by a worker, and the longest that is kept; pairs of pieces whose compatibility is kept.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 700_000, 48, 500_000
#: Between words that are matched in one pass; no piece holds it.
GAP = chr(0xE000)
#: Words that are matched in one pass.
MATCHED = 5000


class PieceCodec:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, model_file: str) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.end_id, self.unknown_id = lib.eos_id(), lib.unk_id()
        self.surface = [lib.id_to_piece(i) for i in range(n)]
        self.rank = {p: (-lib.get_score(i), i) for i, p in enumerate(self.surface) if i not in special}
        self.byte_ids = {int(self.surface[i][3:5], 16): i for i in special if lib.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space after another character; texts can't be split before spaces")
        if any(GAP in p for p in self.rank):
            raise ValueError("a piece holds the character that parts words here")
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.machine = ahocorasick.Automaton()
        self.unreachable = {p for p in self.rank if len(p) > 1 and p.strip(SPACE) and self.merge(p) != [p]}
        for p, (_, i) in self.rank.items():
            if p.strip(SPACE) or len(p) == 1:
                if p not in self.unreachable:
                    self.machine.add_word(p, (i, len(p) - 1))
        self.machine.make_automaton()
        self.shorter: dict[int, int] = {}
        self.sizes = [len(p) for p in self.surface]
        self.bytes_of_decimal = {str(i): p.replace(SPACE, " ").encode() if p in self.rank else b"" for i, p in enumerate(self.surface)}
        self.bytes_of_decimal |= {str(i): bytes([b]) for b, i in self.byte_ids.items()} | {str(self.unknown_id): " ⁇ ".encode()}

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging the best-ranked neighbours, the leftmost first where ranks are equal."""
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        rank = self.rank
        heap = [(r[0], i, len(a) + len(b)) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := rank.get(a + b))]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= len(part) or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
                if r := rank.get(part[i] + part[after[i]]):
                    heapq.heappush(heap, (r[0], i, size + len(part[after[i]])))
            if (k := before[i]) >= 0 and (r := rank.get(part[k] + part[i])):
                heapq.heappush(heap, (r[0], k, size + len(part[k])))
        return [p for p in part if p]

    def compatible(self, a: int, b: int) -> bool:
        """Whether re-merging the text of two neighbours gives these two again."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            left, right = self.surface[a], self.surface[b]
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def next_shorter(self, piece: int) -> int:
        """The longest piece that is a proper prefix of ``piece``; -1 where there is none."""
        found = self.shorter.get(piece)
        if found is None:
            text, found = self.surface[piece], -1
            for n in range(len(text) - 1, 0, -1):
                known = self.rank.get(text[:n])
                if known and (n == 1 or (text[:n].strip(SPACE) and text[:n] not in self.unreachable)):
                    found = known[1]
                    break
            self.shorter[piece] = found
        return found

    def _unmatched(self, char: str) -> list[int]:
        """A character that is no piece: its bytes, or else the unknown id."""
        if not self.byte_ids:
            return [self.unknown_id]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def _backtrack(self, longest: list[int], start: int, end: int) -> list[int]:
        """Ids of a stretch of which each character is a piece, from the longest piece at each position."""
        sizes, pairs = self.sizes, self.pairs
        ids: list[int] = []
        failed, before = bytearray((end - start >> 3) + 1), -1
        at, piece = start, longest[start]
        while True:
            after = at + sizes[piece]
            if not failed[after - start >> 3] >> (after - start & 7) & 1:
                if before >= 0:
                    fits = pairs.get(before << 32 | piece)
                    if fits is None:
                        fits = self.compatible(before, piece)
                if before < 0 or fits:
                    ids.append(piece)
                    if after == end:
                        return ids
                    before, at, piece = piece, after, longest[after]
                    continue
            shorter = self.next_shorter(piece)
            while shorter < 0:
                failed[at - start >> 3] |= 1 << (at - start & 7)
                if not ids:
                    raise ValueError("no compatible sequence of pieces")
                piece = ids.pop()
                before = ids[-1] if ids else -1
                at -= sizes[piece]
                shorter = self.next_shorter(piece)
            piece = shorter

    def _stretch(self, word: str, longest: list[int], start: int, end: int) -> list[int]:
        """Ids of a word that has characters which are no pieces; such a character parts what stands around it."""
        ids: list[int] = []
        first = start
        for at in range(start, end):
            if longest[at] < 0:
                if first < at:
                    ids += self._backtrack(longest, first, at)
                ids += self._unmatched(word[at - start])
                first = at + 1
        if first < end:
            ids += self._backtrack(longest, first, end)
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words; each is a run of spaces and what follows it up to the next space."""
        out: list[list[int]] = []
        for i in range(0, len(words), MATCHED):
            some = words[i : i + MATCHED]
            joined = GAP.join(some)
            longest = [-1] * len(joined)
            for last, (piece, before) in self.machine.iter(joined):
                longest[last - before] = piece
            at = 0
            for word in some:
                end = at + len(word)
                if word[:2] == SPACE * 2:
                    ids: list[int] = []
                    for p in self.merge(word):
                        known = self.rank.get(p)
                        ids += [known[1]] if known else self._unmatched(p)
                    out.append(ids)
                elif -1 in longest[at:end]:
                    out.append(self._stretch(word, longest, at, end))
                else:
                    out.append(self._backtrack(longest, at, end))
                at = end + 1
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text, with the space that the library puts first."""
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, the end id last."""
        return [i for ids in self.encode_words(self.split(text)) for i in ids] + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces put together, bytes read as UTF-8, control ids left out, the first space dropped."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i == self.unknown_id:
                out.append(" ⁇ ")
            elif self.surface[i] in self.rank:
                out.append(self.surface[i].replace(SPACE, " "))
        out.append(_utf8(bytes(run)))
        text = "".join(out)
        return text[1:] if text[:1] == " " else text

    def decode_decimal(self, joined: str) -> str:
        """Text of decimal ids that are joined by spaces."""
        of = self.bytes_of_decimal
        try:
            text = b"".join([of[x] for x in joined.split(" ")]).decode("utf-8")
        except UnicodeDecodeError:
            return self.decode(list(map(int, joined.split(" "))))
        return text[1:] if text[:1] == " " else text

    def clear(self) -> None:
        self.words.clear()
        self.pairs.clear()

    def digest_words(self, texts: list[str]) -> list[tuple[str, int]]:
        """The decimal ids of each text joined by spaces, the end id last, and how many there are."""
        kept = self.words
        holds_tables("pieces", self.clear)
        if len(kept) > KEPT_WORDS:
            kept.clear()
        split = [self.split(t) for t in texts]
        found: set[str] = set()
        for words in split:
            found.update(words)
        new = list(found.difference(kept))
        kept.update((w, " ".join(map(str, ids))) for w, ids in zip(new, self.encode_words(new), strict=True))
        end = str(self.end_id)
        out = []
        for words in split:
            joined = " ".join([*map(kept.__getitem__, words), end])
            out.append((joined, joined.count(" ") + 1))
        for w in new:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        return out


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _utf8(data: bytes) -> str:
    """Bytes as UTF-8; each byte that is part of no character is one replacement character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode("utf-8"))
            out.append("�")
            at += e.start + 1
    return "".join(out)


@cache
def codec(model_file: str) -> PieceCodec:
    """The codec of a worker process, made once."""
    return PieceCodec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: (doc_id, ids array<int>)."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            ids = [list(map(int, s.split(" "))) for s, _ in c.digest_words(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Texts of ids: (doc_id, text); null ids decode to the empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            texts = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number and digest of its ids and the digest of the text that they decode to."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for joined, n in c.digest_words(batch.column("text").to_pylist()):
                counts.append(n)
                ids_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                text_digests.append(hashlib.sha256(c.decode_decimal(joined).encode("utf-8", "surrogatepass")).hexdigest())
            cols = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_piece_codec(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with the 32k merge-type model and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), default_model())
