"""Error types, how model errors are classified, retries, and the evaluation's options."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from typing import NamedTuple


class AppError(Exception):
    """An error with a status, a code and whether trying again may help."""

    status, code, retryable = 500, "internal_error", False

    def response(self) -> dict:
        return {"error_code": self.code, "message": str(self), "retryable": self.retryable}


class InternalError(AppError):
    """Something is set up wrongly; trying again won't help."""


class InvalidQuestion(AppError):
    status, code = 422, "validation_error"


class RateLimited(AppError):
    status, code, retryable = 429, "rate_limited", True


class ModelUnavailable(AppError):
    status, code, retryable = 503, "model_unavailable", True


class DataUnavailable(AppError):
    status, code, retryable = 503, "data_unavailable", True


class IndexUnavailable(DataUnavailable):
    code = "index_unavailable"


class HistoryUnavailable(DataUnavailable):
    code = "history_unavailable"


class GraphUnavailable(DataUnavailable):
    code = "graph_unavailable"


#: Errors of a model's client that say the setup is wrong.
MISCONFIGURED = (KeyError, ValueError, TypeError, ImportError)


def classified(error: Exception, misconfigured: tuple = MISCONFIGURED) -> AppError:
    """An error of a model call as one of ours."""
    if isinstance(error, AppError):
        return error
    return InternalError(str(error)) if isinstance(error, misconfigured) else ModelUnavailable(str(error))


def logged(error: Exception, log: logging.Logger) -> None:
    """A warning if trying again may help, else an error."""
    log.log(logging.WARNING if getattr(error, "retryable", False) else logging.ERROR, "%s: %s", type(error).__name__, error)


def with_retries(call: Callable, attempts: int = 3, first_wait: float = 1.0, most_wait: float = 8.0, sleep: Callable = time.sleep, fallback: Callable | None = None, limited: type = RateLimited, again: type | tuple = ModelUnavailable):
    """``call`` repeated on errors that may pass with doubling waits; a rate limit goes to the fallback for this call only."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except limited:
                if fallback is None:
                    raise
                return fallback(*args)
            except again:
                if k == attempts - 1:
                    raise
                sleep(min(most_wait, first_wait * 2**k))

    return run


class Options(NamedTuple):
    """How an evaluation runs."""

    dataset: str = "dataset.jsonl"
    out: str = "results"
    resume: bool = False
    limit: int | None = None
    skip_judge: bool = False
    judge_model: str | None = None
    retries: int = 2
    wait: float = 30.0
    sleep: float = 0.5
    price_in: float | None = None
    price_out: float | None = None
    trace: bool = False


def attempted(call: Callable, options: Options = Options(), sleep: Callable = time.sleep, any_error: bool = False) -> tuple[object, int, AppError | None]:
    """(result, attempts, error): ``call`` with the evaluation's retries on errors that may pass (``any_error``: on all); the last error is kept, not raised."""
    for k in range(1, options.retries + 2):
        try:
            return call(), k, None
        except Exception as e:
            error = classified(e, ())
            if k > options.retries or not (any_error or getattr(e, "retryable", False)):
                return None, k, error
            sleep(options.wait)
