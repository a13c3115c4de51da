"""Asking a labeller about pictures, one client a task; what it is and where it runs is the caller's choice."""

from __future__ import annotations

import base64
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.plans.session import ship_package

#: Seconds to wait after the first and second failed attempt.
PAUSES = (0.8, 1.6)


def asked(ask: Callable[[], str], pauses: tuple[float, ...] = PAUSES) -> str:
    """The answer; lost connections and timeouts are tried again, once for each pause, anything else is raised."""
    for pause in pauses:
        try:
            return ask()
        except (ConnectionError, TimeoutError):
            time.sleep(pause)
    return ask()


def with_answers(icons: DataFrame, client: Callable[[], Callable[[bytes, str], str]] | None = None, *, picture: str = "png", prompt: str = "prompt", name: str = "answer", pauses: tuple[float, ...] = PAUSES) -> DataFrame:
    """Adds the labeller's answer to every row; null where there is no picture or the labeller fails, so that one
    picture never fails the job. ``client`` is called once a task and gives the function that answers."""
    ship_package(icons.sparkSession)
    schema = StructType([*icons.schema, StructField(name, StringType())])

    def run(stream):
        ask = (client or no_client)()

        def answer(content, words):
            try:
                return asked(lambda: ask(content, words), pauses)
            except Exception:  # the row keeps its old name
                return None

        for rows in stream:
            has = rows[picture].notna()
            found = [answer(p, w) if h else None for p, w, h in zip(rows[picture], rows[prompt], has, strict=True)]
            yield rows.assign(**{name: pd.Series(found, index=rows.index, dtype=object)})

    return icons.mapInPandas(run, schema)


def generate_request(model: str, prompt: str, png: bytes) -> dict:
    """Body of a generate call: fixed format of that server's interface."""
    return {"model": model, "prompt": prompt, "images": [base64.b64encode(png).decode()], "stream": False}


def chat_request(model: str, prompt: str, png: bytes, media: str = "image/png") -> dict:
    """Body of a chat call with a picture: fixed format of that server's interface. A server that has one model needs no name."""
    picture = {"type": "image_url", "image_url": {"url": f"data:{media};base64,{base64.b64encode(png).decode()}"}}
    body = {"messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, picture]}], "stream": False, "temperature": 0}
    return body | ({"model": model} if model else {})


def no_client() -> Callable[[bytes, str], str]:
    """The labeller that is used where none is given: it answers nothing, so that icons keep their stems."""
    return lambda picture, prompt: ""
