"""Vectors of texts by a model: a tokenizer file and an ONNX model of token ids to hidden states, whose masked mean of unit length is the vector.

No model file comes with the library; any that takes input_ids and attention_mask (and token_type_ids, if it asks for them) will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import ModelFailed


class Tokenizer:
    """A tokenizer file: texts to ids and back."""

    def __init__(self, path: str, longest: int = 512):
        import tokenizers

        try:
            self.inner = tokenizers.Tokenizer.from_file(path)
        except Exception as e:
            raise ModelFailed(f"no tokenizer: {path}: {e}") from e
        self.longest = longest

    def encode(self, texts: list[str], special: bool = True) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch(texts, add_special_tokens=special)]

    def decode(self, ids: list[list[int]], skip_special: bool = True) -> list[str]:
        return self.inner.decode_batch(ids, skip_special_tokens=skip_special)

    def vocab_size(self) -> int:
        return self.inner.get_vocab_size()

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask), cut and padded with 0 to the longest text, `longest` at most."""
        rows = [ids[: self.longest] for ids in self.encode(texts)]
        width = max(1, max(map(len, rows), default=1))
        ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
        for k, r in enumerate(rows):
            ids[k, : len(r)], mask[k, : len(r)] = r, 1
        return ids, mask


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the states where the mask is 1, of unit length; zeros stay."""
    weight = mask[:, :, None].astype(np.float64)
    mean = (states.astype(np.float64) * weight).sum(1) / np.maximum(weight.sum(1), 1)
    size = np.sqrt((mean**2).sum(1, keepdims=True))
    return mean / np.where(size > 0, size, 1)


class Encoder:
    """texts -> unit vectors."""

    def __init__(self, model: str, tokenizer: str, longest: int = 512, threads: int = 1):
        import onnxruntime

        self.files = (model, tokenizer, longest)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = threads
        try:
            self.session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        except Exception as e:
            raise ModelFailed(f"no model: {model}: {e}") from e
        self.tokenizer = Tokenizer(tokenizer, longest)
        self.inputs = [x.name for x in self.session.get_inputs()]

    def __reduce__(self):
        """Tasks load the files themselves."""
        return loaded, self.files

    def __call__(self, texts: list[str], batch: int = 32) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), batch):
            ids, mask = self.tokenizer.matrix(texts[k : k + batch])
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            out += pooled(self.session.run(None, {x: given[x] for x in self.inputs})[0], mask).tolist()
        return out


@lru_cache(maxsize=2)
def loaded(model: str, tokenizer: str, longest: int) -> Encoder:
    """One session for each Python worker."""
    return Encoder(model, tokenizer, longest)


def encode_frame(docs: DataFrame, model: str, tokenizer: str, id_col: str = "path", text_col: str = "content", longest: int = 512) -> DataFrame:
    """(id, embedding) of each row; a null text has a null vector. Files of the model must be readable by all executors."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = loaded(model, tokenizer, longest)
        for x in it:
            texts = x.column(1).to_pylist()
            known = iter(of([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([None if t is None else next(known) for t in texts], pa.list_(pa.float64()))], [id_col, "embedding"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(batches, f"`{id_col}` {kind}, embedding array<double>")
