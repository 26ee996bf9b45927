"""Token counts of whole texts, without keeping the ids."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_map

# A cut before a single blank between two ASCII letters never runs through a pre-token of byte-level BPE.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
# Outside these characters the two libraries' Unicode tables are not compared here, so the reference library counts.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u017f]")


class TextEncoder:
    """Ids of a text as the file's own library gives them, special strings handled as its default, none added.

    `.json` is read by tokenizers and `.model` by sentencepiece. ranks names the same vocabulary as tiktoken ranks with
    its pattern and special tokens; texts of ASCII and Latin letters then go through that faster equal encoder.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.fast = path, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.exact = lambda texts: model.encode(texts, num_threads=1)
        elif path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            exact = Tokenizer.from_file(path)
            exact.no_truncation()
            exact.no_padding()
            self.exact = lambda texts: [e.ids for e in exact.encode_batch_fast(texts, add_special_tokens=False)]
            if ranks and pattern:
                import tiktoken

                with open(ranks, "rb") as lines:
                    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
                special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
                fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
                self.fast = lambda text: fast.encode(text, allowed_special="all")
        else:
            raise ValueError(f"no library for {path}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.fast:
            return self.exact(texts)
        out = [None if _OTHER.search(t) else self.fast(t) for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.exact([texts[i] for i in rest]) if rest else []):
            out[i] = ids
        return out

    @property
    def splits(self) -> bool:
        return self.path.endswith(".json") and self.fast is not None

    def count(self, texts: list[str], piece_chars: int) -> list[int]:
        """Ids per text. Texts over piece_chars are cut at safe boundaries of byte-level BPE and their parts summed."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = safe_pieces(text, piece_chars) if self.splits else [text]
            parts += pieces
            owner += [i] * len(pieces)
        out = [0] * len(texts)
        for i, ids in zip(owner, self.encode(parts)):
            out[i] += len(ids)
        return out


def safe_pieces(text: str, piece_chars: int) -> list[str]:
    """text in parts of about piece_chars, cut only before a blank between two ASCII letters; whole if there is none."""
    out, at = [], 0
    while len(text) - at > piece_chars:
        cut = _SAFE.search(text, at + piece_chars)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> TextEncoder:
    return TextEncoder(path, ranks, pattern)


def byte_bpe() -> tuple[str, str, str]:
    """Arguments of encoder() for the public 50k byte-level vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def count_tokens(df: DataFrame, tokenizer: tuple, limit: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    Null text counts as empty; null ids and repeated rows stay, a row each; other columns of df aren't looked at. An
    empty table gives an empty result. A batch given to the encoder holds about batch_bytes.
    """

    def rows(columns):
        ids, texts = columns
        texts = [t or "" for t in texts]
        counts = encoder(*tokenizer).count(texts, piece_chars)
        return [ids, [len(t.encode()) for t in texts], counts, [n > limit for n in counts]]

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), rows, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", batch_bytes)
