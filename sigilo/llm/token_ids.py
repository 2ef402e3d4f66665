"""Token ids of many texts by the tokenizers library, with repeated words taken from a memo.

The tokenizer's words never reach across white space, so a text's ids are
those of its runs between white space, one after the other. Runs not seen
before go to the library in batches; the memo is bounded and changes nothing.
"""

from __future__ import annotations

import os
import re
from array import array

from tokenizers import Tokenizer

MEMO_RUNS, MEMO_CHARS = 500_000, 48
#: Texts with these go to the library whole: str.split() would part them elsewhere than it does.
ODD = re.compile("[\x1c-\x1f]")


class TokenIds:
    """Ids, packed as little-endian unsigned 32-bit integers, of whole texts."""

    _loaded: dict[str, TokenIds] = {}

    @classmethod
    def load(cls, path: str) -> TokenIds:
        """One per path and worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: What was met since the memo was last full, and what was met before.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def by_library(self, texts: list[str]) -> list[bytes]:
        out = []
        for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
            ids = array("I", e.ids)
            out.append(ids.tobytes())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object per text; null is empty."""
        get = self.memo.get
        found: list[list[bytes | None]] = []
        runs: list[list[str]] = []
        fresh: dict[str, bytes | None] = {}
        for text in texts:
            own = (text or "").split() if not ODD.search(text or "") else [text or ""]
            ids = [get(r) for r in own]
            if None in ids:
                for k, i in enumerate(ids):
                    if i is None:
                        if (known := self.older.get(own[k])) is not None:
                            ids[k] = self.memo[own[k]] = known
                        else:
                            fresh[own[k]] = None
            runs.append(own)
            found.append(ids)
        if fresh:
            words = list(fresh)
            fresh = dict(zip(words, self.by_library(words), strict=True))
            if len(self.memo) + len(fresh) > MEMO_RUNS:
                self.older, self.memo = self.memo, {}
                get = self.memo.get
            self.memo.update((r, i) for r, i in fresh.items() if len(r) <= MEMO_CHARS)
        return [b"".join([i if i is not None else fresh[r] for r, i in zip(own, ids, strict=True)] if None in ids else ids) for own, ids in zip(runs, found, strict=True)]
