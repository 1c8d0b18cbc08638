"""What the packing of the pipeline leaves in a Python worker, which later stages use."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from textquarry.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pieces(keep):
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["one two", None])})
    return pa.Table.from_batches(packing._pieces(PATH, 2048, 0, 1 << 20, keep)(iter([batch]))).to_pylist()


def test_encoders_are_dropped_where_other_steps_follow():
    kept = pieces(keep=True)
    assert tokens._encoders
    assert pieces(keep=False) == kept and not tokens._encoders


def test_the_pipeline_drops_them(monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "token_pieces", lambda docs, path, **given: asked.update(given))
    monkeypatch.setattr(packing, "pack", lambda rows: rows)
    corpus_pipeline.best_fit_packing(None, None, "")
    assert asked["keep"] is False
