"""Stand-in predictors for tests of the inference operator."""

from __future__ import annotations


def echo_predictor(question: str = "input", gold: str = "output", tail_words: int = 6):
    """Echoes the question, gives the gold answer and repeats its last words."""

    def make():
        def predict(batch):
            out = []
            for q, g in zip(batch[question], batch[gold]):
                q, g = q or "", g or ""
                out.append(q + " " + g + " " + " ".join(g.split()[-tail_words:]))
            return out
        return predict
    return make


def failing_predictor(fail_when, inner):
    """Wraps a predictor so that batches matching ``fail_when`` raise."""

    def make():
        p = inner()

        def predict(batch):
            if fail_when(batch):
                raise RuntimeError("simulated generation failure")
            return p(batch)
        return predict
    return make
