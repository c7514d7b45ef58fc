"""Documents to hand out: pages in order as one PDF file."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame

from vellum.sources.files import Pdf


def pdf(pictures: list[tuple[bytes, int, int]]) -> bytes:
    """A PDF file with one JPEG picture (bytes, width, height) on each page; colour is what their headers say."""
    out = io.BytesIO()
    file = Pdf(out)
    for picture in pictures:
        file.page(*picture)
    file.end()
    return out.getvalue()


def pdf_documents(pages: DataFrame) -> DataFrame:
    """(document, pages, content) of pages (document, place, content, width, height): each document as one PDF in one value, its pages by place.

    A value has 2 GB at most; ``vellum.sources.files.write_pdfs`` writes documents of any size as files.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("place")
        content = pdf([(bytes(c), int(w), int(h)) for c, w, h in zip(ordered["content"], ordered["width"], ordered["height"], strict=True)])
        return pd.DataFrame({"document": [ordered["document"].iloc[0]], "pages": [len(ordered)], "content": [content]})

    return pages.groupBy("document").applyInPandas(run, "document long, pages long, content binary")
