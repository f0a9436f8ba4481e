"""Problem 6: encoding of every text with a public byte-level BPE tokenizer, by recursive queries.

Each partition cuts its texts into words with the tokenizer's public pattern and encodes each *distinct* word
once: a recursive DuckDB query holds one row per (word, token position), joins neighbouring tokens to the
merge table and contracts the leftmost pair of least rank of every word, until no word has a pair left.
Ordered aggregation then gives each word its ids, and the ids of a text are those of its words in turn. No row leaves its
partition, so the operator needs no shuffle at all. A long word (a run without a break may have any length) is contracted in pieces and mended at the seams, so that its time
grows with its length: a sequence of tokens is the encoding of its bytes if every two neighbours are the encoding of theirs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Folder of the public tokenizer files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Splits a text into the words inside which merges happen. Fixed value of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept by a Python worker between batches; beyond it the memory is emptied, never the result.
CACHE_WORDS = 200_000
#: Rows that one recursive query may hold at most, as the sum of the squares of its words' lengths.
QUERY_ROWS = 1_500_000
#: Bytes from which a word (a run of letters, signs or white space without a break) is contracted in pieces, and bytes of a piece.
LONG_WORD, PIECE = 200, 64

_ENCODERS: dict[str, BpeEncoder] = {}


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeEncoder:
    """The merge table of ``<name>.json`` in an in-memory DuckDB, with the recursive query over it."""

    QUERY = """
        with recursive step(word, turn, pos, tok) as (
            select word, 0, pos, tok from start
            union all
            select word, turn + 1, pos, tok from (
                with linked as (
                    select word, turn, pos, tok, lead(tok) over line as after, lag(pos) over line as prior
                    from step window line as (partition by word order by pos)
                ), ranked as (
                    select l.*, m.rank, m.made from linked l left join merges m on m.a = l.tok and m.b = l.after
                ), best as (
                    select word, min(rank * 1099511627776 + pos) as pick from ranked where rank is not null group by word
                )
                select r.word, r.turn, r.pos, case when r.pos = b.pick % 1099511627776 then r.made else r.tok end as tok
                from ranked r join best b on b.word = r.word
                where r.prior is null or r.prior <> b.pick % 1099511627776
            )
        ), last as (select word, max(turn) as turn from step group by word)
        select s.word, list(s.tok order by s.pos) as ids from step s join last l on l.word = s.word and l.turn = s.turn group by s.word
    """

    def __init__(self, name: str, folder: str) -> None:
        import duckdb
        import pandas as pd
        import regex

        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], _byte_symbols()
        self.of_byte = [0] * 256
        for symbol, byte in symbols.items():
            self.of_byte[byte] = vocab[symbol]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = pd.DataFrame([(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)], columns=["a", "b", "rank", "made"])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("create table merges as select a::int as a, b::int as b, rank::bigint as rank, made::int as made from merges")
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            if all(c in symbols for c in token):
                self.bytes_of[number] = bytes(symbols[c] for c in token)
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}

    def contract(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of each byte sequence, by the recursive query over as many of them at a time as ``QUERY_ROWS`` allows."""
        import numpy as np
        import pandas as pd

        of_byte, out = np.array(self.of_byte, dtype="int32"), [[] for _ in raw]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))  # sequences of like length end after like many turns
        at = 0
        while at < len(order):
            end, rows = at, 0
            while end < len(order) and (end == at or rows + len(raw[order[end]]) ** 2 <= QUERY_ROWS):
                rows += len(raw[order[end]]) ** 2
                end += 1
            part = [raw[k] for k in order[at:end]]
            sizes = np.array([len(x) for x in part])
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tok = of_byte[np.frombuffer(b"".join(part), dtype="uint8")]
            start = pd.DataFrame({"word": np.repeat(np.arange(len(part), dtype="int32"), sizes), "pos": pos.astype("int64"), "tok": tok})
            self.db.register("start", start)
            got = self.db.execute(self.QUERY).fetchnumpy()
            self.db.unregister("start")
            for k, ids in zip(got["word"].tolist(), got["ids"]):
                out[order[at + k]] = [int(i) for i in ids]
            at = end
        return out

    def _piece_ids(self, raw: list[bytes]) -> list[list[int]]:
        new = list({x for x in raw if x not in self.pieces})
        if len(self.pieces) + len(new) > CACHE_WORDS:
            self.pieces.clear()
            new = list(set(raw))
        for x, ids in zip(new, self.contract(new)):
            self.pieces[x] = ids
        return [self.pieces[x] for x in raw]

    def _long(self, raw: bytes) -> list[int]:
        """Ids of a long byte sequence: pieces are contracted, then every place where two neighbours aren't the encoding of their bytes is contracted again with more around it."""
        parts = self._piece_ids([raw[k : k + PIECE] for k in range(0, len(raw), PIECE)])
        ids = [i for part in parts for i in part]
        joins, at = [], 0
        for part in parts[:-1]:
            at += len(part)
            joins.append(at)
        reach = 1
        while joins:
            pairs = [(ids[k - 1], ids[k]) for k in joins]
            both = self._piece_ids([self.bytes_of[a] + self.bytes_of[b] for a, b in pairs])
            wrong = [k for k, (a, b), ab in zip(joins, pairs, both) if ab != [a, b]]
            if not wrong:
                break
            spans: list[list[int]] = []
            for k in wrong:
                low, high = max(0, k - reach), min(len(ids), k + reach)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            fresh = self._piece_ids([b"".join(map(self.bytes_of.__getitem__, ids[low:high])) for low, high in spans])
            out, joins, last = [], [], 0
            for (low, high), new in zip(spans, fresh):
                out += ids[last:low]
                if low:
                    joins.append(len(out))
                out += new
                if high < len(ids):
                    joins.append(len(out))
                last = high
            ids = out + ids[last:]
            reach *= 2
        return ids

    def learn(self, words: list[str]) -> None:
        """Encodes ``words`` and keeps their ids."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [k for k, x in enumerate(raw) if len(x) <= LONG_WORD]
        for k, ids in zip(short, self.contract([raw[k] for k in short])):
            self.known[words[k]] = ids
        for w, x in zip(words, raw):
            if len(x) > LONG_WORD:
                self.known[w] = self._long(x)

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list({w for words in cut for w in words if w not in self.known})
        if new:
            self.learn(new)
        known, out = self.known, []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out

    def decode(self, ids: list[list[int] | None]) -> list[str]:
        """The texts of lists of ids: the bytes of the tokens, put together in their order by one ordered aggregation."""
        import numpy as np
        import pandas as pd

        if not self.db.execute("select 1 from information_schema.tables where table_name = 'tokens'").fetchall():
            tokens = pd.DataFrame({"tok": np.arange(len(self.bytes_of)), "shown": [x.hex() for x in self.bytes_of]})
            self.db.execute("create table tokens as select tok::int as tok, shown from tokens")
        sizes = np.array([len(x or []) for x in ids], dtype="int64")
        flat = pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), sizes), "pos": np.arange(sizes.sum()), "tok": np.array([i for x in ids for i in x or []], dtype="int32")})
        self.db.register("coded", flat)
        got = self.db.execute("select doc, string_agg(shown, '' order by pos) from coded join tokens using (tok) group by doc").fetchall()
        self.db.unregister("coded")
        out = [""] * len(ids)
        for doc, shown in got:
            out[doc] = bytes.fromhex(shown).decode("utf-8", "surrogatepass")
        return out


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> BpeEncoder:
    """The encoder of this Python worker, made once."""
    key = f"{folder}/{name}"
    if key not in _ENCODERS:
        _ENCODERS[key] = BpeEncoder(name, folder)
    return _ENCODERS[key]


def _encoded(name: str, folder: str, sizes_only: bool, rows: int = 2_000):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = own.encode(part.column(1).to_pylist())
                out = pa.array([len(x) for x in ids], pa.int64()) if sizes_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["id", "out"])

    return run


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, ids array<int>)``: one row per row of ``df``, without special tokens.

    Text that looks like a special token is plain text. Null and empty texts give an empty list; white space is
    encoded as it stands. Repeated ids give repeated rows; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_col).mapInArrow(_encoded(tokenizer, folder, False), f"id {kind}, out array<int>")
    return rows.select(rows["id"].alias(id_col), rows["out"].alias("ids"))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, n_tokens bigint)``: the lengths of what ``encode_texts`` gives, 0 for null and empty texts."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_col).mapInArrow(_encoded(tokenizer, folder, True), f"id {kind}, out bigint")
    return rows.select(rows["id"].alias(id_col), rows["out"].alias("n_tokens"))


def decode_ids(ids: list[int], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text of ``ids``."""
    return encoder(tokenizer, folder).decode([ids])[0]


def decode_texts(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, rows: int = 500) -> DataFrame:
    """``(id_col, text)``: the text of each list of ids; null and empty lists give an empty text. Ids that aren't UTF-8 together are an error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(tokenizer, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.decode(part.column(1).to_pylist()), pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string")
    return out.select(out["id"].alias(id_col), "text")
