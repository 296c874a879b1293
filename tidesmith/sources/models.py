"""Streaming neural enhancers as exported models, one session for each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..kernels import spectral


class StreamingModel:
    """An exported frame-by-frame model: the first input is a spectrum (1, 2, 1, bins), the others and all later outputs are its state."""

    def __init__(self, path: str, threads: int = 1) -> None:
        try:
            import onnxruntime as ort
        except ImportError as e:
            raise RuntimeError("onnxruntime is not installed, so exported models cannot run") from e
        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = threads
        self.session = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        self.inputs = self.session.get_inputs()
        self.reset()

    def reset(self) -> None:
        self.state = [np.zeros([d if isinstance(d, int) else 1 for d in i.shape], np.float32) for i in self.inputs[1:]]
        self.last_gain = None

    def frame(self, spec: np.ndarray) -> np.ndarray:
        x = np.stack([spec.real, spec.imag]).astype(np.float32)[None, :, None, :]
        out, *self.state = self.session.run(None, dict(zip((i.name for i in self.inputs), [x, *self.state], strict=True)))
        y = out.reshape(2, -1)
        y = y[0] + 1j * y[1]
        self.last_gain = np.abs(y) / (np.abs(spec) + 1e-12)
        return y


def enhance_with_model(df: DataFrame, path: str, samples: str = "samples") -> DataFrame:
    """df with signals enhanced by the model at `path`, which every executor must be able to open."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = StreamingModel(path)
        for p in parts:
            out = []
            for x in p[samples]:
                model.reset()
                x = np.asarray(x, float)
                out.append(spectral.istft(np.array([model.frame(s) for s in spectral.stft(x)]), len(x)))
            yield p.assign(**{samples: out})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
