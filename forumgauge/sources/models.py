"""Persisting fitted models between stages."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer


def save_model(model: Transformer, path: str) -> str:
    """Save a fitted model (wrapped as a pipeline so one loader fits all)."""
    if not isinstance(model, PipelineModel):
        model = PipelineModel(stages=[model])
    model.write().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
