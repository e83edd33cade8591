"""BPE with word ends as a streaming transducer, and its decoder.

Text is read in chunks cut at blanks, so memory depends on the chunk and not
on the text. A word that ends within the window is merged at once. A longer
one goes through the transducer, which keeps, for the last ``horizon``
symbols only, the last token of the segmentation of every prefix: a prefix's
segmentation ends with the one token that agrees with the token before it.
No token is longer than ``horizon`` symbols (computed from the merge list), so
whatever follows continues one of those prefixes; tokens that all of them
share are stable and are emitted.
"""
from __future__ import annotations

import codecs
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.common import text_or_empty

#: Characters of a chunk, at least; a chunk ends at the next blank.
CHUNK = 1 << 16
#: Words kept with their tokens in a task; the table starts anew when full.
CACHE_WORDS = 1 << 18
#: Symbols up to which a word is merged at once.
WINDOW = 64
_BLANK = regex.compile(r"[ \n\t\r]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars = {b: chr(b) for b in shown}
    for b in range(256):
        chars.setdefault(b, chr(256 + len(chars) - len(shown)))
    return [chars[b] for b in range(256)]


class Merges:
    """The merge list as tables over token ids."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.rank: dict[int, tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.size: dict[int, int] = {}
        for r, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(x << 32 | y, (r, z))
            self.parts.setdefault(z, (r, x, y))
            self.size[z] = self.size.get(x, 1) + self.size.get(y, 1)
        #: The sufficient lookahead of one token: the most symbols a token covers.
        self.horizon = max(self.size.values(), default=1)
        self._agree: dict[int, bool] = {}
        # a token as the symbols below it, for the transducer's lookup; only
        # tokens that their own symbols merge into can ever be emitted
        self._symbols: dict[int, tuple[int, ...]] = {}
        self.by_symbols = {self.symbols(z): z for z in self.parts if self.merge(list(self.symbols(z))) == [z]}

    def symbols(self, token: int) -> tuple[int, ...]:
        got = self._symbols.get(token)
        if got is None:
            p = self.parts.get(token)
            got = (token,) if p is None else self.symbols(p[1]) + self.symbols(p[2])
            self._symbols[token] = got
        return got

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a short word, the best-ranked leftmost first."""
        rank = self.rank
        while len(ids) > 1:
            best, at = None, -1
            a = ids[0]
            for i in range(1, len(ids)):
                b = ids[i]
                got = rank.get(a << 32 | b)
                if got is not None and (best is None or got[0] < best[0]):
                    best, at = got, i - 1
                a = b
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
        return ids

    def agree(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when they stand side by side.

        Goes back in time from the finished tokens: the one made last is taken
        apart, and what then touches across the boundary must not have a merge
        that would have come before the one taken back. Of equal ranks the
        left merge comes first.
        """
        key = a << 32 | b
        got = self._agree.get(key)
        if got is not None:
            return got
        if len(self._agree) > CACHE_WORDS:
            self._agree.clear()
        rank, parts, limit, got = self.rank, self.parts, len(self.rank), True
        while True:
            across = rank.get(a << 32 | b)
            if across is not None and across[0] < limit:
                got = False
                break
            left, right = parts.get(a), parts.get(b)
            if left is None and right is None:
                break
            if right is None or left is not None and left[0] > right[0]:
                limit, a = left[0], left[2]
            else:
                limit, b = right[0] + 1, right[1]
        self._agree[key] = got
        return got

    def stream(self, symbols: Iterator[int]) -> Iterator[int]:
        """Tokens of a long word, each emitted as soon as it is stable."""
        seen: list[int] = []  # the last symbols, from place ``base``
        last: list[tuple[int, int] | None] = [None]  # per prefix: its last token and where that starts
        base, done, n = 0, 0, 0
        for symbol in symbols:
            seen.append(symbol)
            n += 1
            found = None
            for start in range(max(done, n - self.horizon), n):
                piece = tuple(seen[start - base : n - base])
                token = piece[0] if len(piece) == 1 else self.by_symbols.get(piece)
                if token is None:
                    continue
                before = last[start - base]
                if start == 0 or start == done and before is None or before and self.agree(before[0], token):
                    found = (token, start)
                    break
            last.append(found)
            if n - done >= 2 * self.horizon and n % self.horizon == 0:
                stable = self._stable(last, base, n)
                if stable and stable[-1][1] > done:
                    for token, end in stable:
                        if end > done:
                            yield token
                            done = end
                    # keep the last emitted token, which its successor must agree with
                    keep = done - base
                    seen, last, base = seen[keep:], last[keep:], done
        yield from (t for t, end in self._path(last, base, n) if end > done)

    @staticmethod
    def _path(last, base: int, n: int) -> list[tuple[int, int]]:
        """(token, end) of the segmentation of the first n symbols, from ``base`` on."""
        out = []
        while n > base and last[n - base] is not None:
            token, start = last[n - base]
            out.append((token, n))
            n = start
        return out[::-1]

    def _stable(self, last, base: int, n: int) -> list[tuple[int, int]]:
        """What the segmentations of all live prefixes share."""
        paths = [self._path(last, base, m) for m in range(max(base, n - self.horizon), n + 1) if m == base or last[m - base]]
        shared = []
        for step in zip(*paths):
            if any(x != step[0] for x in step):
                break
            shared.append(step[0])
        return shared


class Encoder:
    """NFC, lower case, words by pattern, byte-level symbols, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.merges = Merges(vocab, model["merges"])
        chars = byte_chars()
        self.chars = "".join(chars)
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + end] for c in chars]
        # tokens by their characters, inside a word and at its end
        emitted = {*self.inner, *self.final, *self.merges.by_symbols.values()}
        self.inside = {t: i for t, i in vocab.items() if i in emitted and not t.endswith(end)}
        self.closing = {t.removesuffix(end): i for t, i in vocab.items() if i in emitted and t.endswith(end)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the tokenizer's blank class is the Unicode property, without the separators U+001C to U+001F
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.decoder = Decoder(self.tokens, spec["decoder"])
        self.cache: dict[str, tuple[str, str, int]] = {}

    def segment(self, word: str) -> list[int]:
        """Tokens of a word that fits the window: the one way to cut it into
        tokens of which all neighbours agree, longest first."""
        n, inside, agree = len(word), self.inside, self.merges.agree
        out: list[int] = []
        ends: list[int] = [0]
        dead: set[int] = set()
        end = n
        while True:
            start = ends[-1]
            while end > start:
                if end not in dead:
                    token = self.closing.get(word[start:]) if end == n else inside.get(word[start:end])
                    if token is not None and (not out or agree(out[-1], token)):
                        break
                end -= 1
            if end > start:
                out.append(token)
                if end == n:
                    return out
                ends.append(end)
                end = n
            else:  # nothing goes on from here
                dead.add(start)
                end = ends.pop() - 1
                out.pop()

    def word_ids(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        if len(data) <= WINDOW:
            return self.segment("".join([self.chars[b] for b in data]))
        last = len(data) - 1
        return list(self.merges.stream(self.final[b] if i == last else self.inner[b] for i, b in enumerate(data)))

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """The words of a text chunk by chunk; a special string is its id."""
        for part in self.split.split(text) if self.split and "<|" in text else (text,):
            if part in self.special:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                stop = _BLANK.search(part, at + CHUNK) if len(part) - at > CHUNK else None
                end = stop.start() if stop else len(part)
                chunk = part[at:end]
                if not chunk.isascii():
                    chunk = unicodedata.normalize("NFC", chunk)
                # lower case letter by letter: no final sigma
                chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
                yield self.words.findall(chunk)
                at = end

    def look_up(self, words: list[str]) -> list[tuple[str, str, int]]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for word in set(words).difference(cache):
            ids = self.word_ids(word)
            cache[word] = (" ".join(map(str, ids)), self.decoder.text(ids), len(ids))
        return [cache[w] for w in words]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words in self.pieces(text):
            if isinstance(words, int):
                out.append(words)
            else:
                for ids, _, _ in self.look_up(words):
                    out.extend(map(int, ids.split(" ")))
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids and of the decoded text, both
        fed as the tokens come."""
        ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
        for words in self.pieces(text):
            if isinstance(words, int):
                got = [(str(words), self.decoder.text([words]), 1)]
            elif words:
                got = self.look_up(words)
            else:
                continue
            if n:
                ids_sha.update(b" ")
                text_sha.update(self.decoder.between)
            ids_sha.update(" ".join([g[0] for g in got]).encode())
            text_sha.update(self.decoder.between.decode().join([g[1] for g in got]).encode())
            n += sum([g[2] for g in got])
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


class Decoder:
    """Ids to text, a token at a time.

    A vocabulary without a decoder gives its tokens as they stand, a blank
    between them. A byte-level one maps every token's characters back to bytes
    and feeds them to a UTF-8 state machine, which holds at most the bytes of
    an unfinished character.
    """

    def __init__(self, tokens: dict[int, str], decoder: dict | None):
        self.tokens = tokens
        self.byte_level = bool(decoder) and decoder["type"] == "ByteLevel"
        self.between = b"" if self.byte_level else b" "
        self.bytes = {c: b for b, c in enumerate(byte_chars())}

    def feed(self, ids: Iterator[int]) -> Iterator[str]:
        if not self.byte_level:
            for k, i in enumerate(ids):
                yield (" " if k else "") + self.tokens[i]
            return
        state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            yield state.decode(bytes(self.bytes[c] for c in self.tokens[i]))
        yield state.decode(b"", final=True)

    def text(self, ids: list[int]) -> str:
        return "".join(self.feed(ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Tokens of every whole text, or with ``digest`` their digests.

    Returns ``id_col`` and ids (array<int>) and decoded; with ``digest``
    n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 instead. Null texts are empty and have no tokens. One row
    in, one row out, without a shuffle: repeated rows, null ids and empty
    tables need no care, and other columns are not read. ``path`` names a
    tokenizer file that every executor can open.
    """
    schema = "_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            if digest:
                rows = [enc.digests(t.as_py()) for t in batch.column(1)]
                kinds, names = (pa.int64(), pa.string(), pa.string()), ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                rows = [(ids := enc.encode(t.as_py()), enc.decoder.text(ids)) for t in batch.column(1)]
                kinds, names = (pa.list_(pa.int32()), pa.string()), ["ids", "decoded"]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["_id", *names])

    out = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)
