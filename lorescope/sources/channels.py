"""Message pages of five channel layouts as rows (SRC-9..12, CH-1, CH-8, CH-9)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.channel import clean_author, clean_title, message_date
from .html import block_text, parse, select, words


@dataclass(frozen=True)
class ChannelConfig:
    """Where a layout keeps a message and its parts; `layout` is that of the date."""

    message: str
    title: str
    author: str
    date: str
    body: str
    layout: str
    entries: str = "//a[@href]"
    per_page: int = 1
    quote: str = ""
    skip_reply_titles: bool = False


CHANNELS = {
    "apache_mail": ChannelConfig("//body", '//tr[@class="subject"]/td[@class="right"] | //title', '//tr[@class="from"]/td[@class="right"]', '//tr[@class="date"]/td[@class="right"]', "//pre", "mail"),
    "phpbb": ChannelConfig('//div[contains(@class, "post ")]', "//h3", '//p[@class="author"]/strong', '//p[@class="author"]', '//div[@class="content"]', "board", '//a[@class="topictitle"]', 25, "", True),
    "fudeclipse": ChannelConfig('//table[@class="MsgTable"]', '//a[@class="MsgSubText"]', '//td[@class="msgud"]', '//span[@class="DateText"]', '//span[@class="MsgBodyText"]', "forum", '//a[@class="big"]', 40),
    "sourceforge": ChannelConfig('//table[@class="forum"]', '//td[@class="title"]', '//td[@class="author"]', '//td[@class="date"]', "//pre", "tracker", '//a[contains(@href, "message")]'),
    "gmane": ChannelConfig("//body", '//td[@class="subject"]', '//td[@class="from"]', '//td[@class="date"]', "//pre", "news", '//a[contains(@href, "article")]', 1, "_"),
}


def messages(pages: DataFrame, key: str, html: str, config: ChannelConfig) -> DataFrame:
    """CH-1, CH-8: key, page_index (of pages: position of the page in its thread), index, title, author, msg_date, body, word_count."""

    def text(root, xpath):
        hits = select(root, xpath)
        return hits[0].text().strip() if hits else None

    def run(batches):
        for b in batches:
            out = []
            for k, page, source in zip(b[key], b["page_index"], b[html]):
                for i, m in enumerate(select(parse(source), config.message)):
                    body = select(m, config.body)
                    said = block_text(body[0]) if body else ""
                    if config.quote:
                        said = re.sub(rf"(?m)^{re.escape(config.quote)}+ ?", "> ", said)
                    out.append((k, int(page) * config.per_page + i, text(m, config.title), text(m, config.author), text(m, config.date), said, words(said)))
            yield pd.DataFrame(out, columns=[key, "index", "raw_title", "raw_author", "raw_date", "body", "word_count"])

    rows = pages.select(key, "page_index", html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, index int, raw_title string, raw_author string, raw_date string, body string, word_count int")
    return rows.select(key, "index", clean_title("raw_title").alias("title"), clean_author("raw_author").alias("author"), message_date("raw_date", config.layout).alias("msg_date"), "body", "word_count")


def month_urls(c: str):
    """SRC-9: a month's overview by date instead of by browser."""
    return F.regexp_replace(F.col(c), "browser$", "date")


def without_session(c: str):
    """SRC-10: forum URLs without their session."""
    return F.regexp_replace(F.col(c), r"&sid=\w+", "")


def page_count(c: str):
    """SRC-11: n of "Pages (n)"."""
    return F.coalesce(F.try_to_number(F.regexp_extract(F.col(c), r"Pages\s*\((\d+)", 1), F.lit("99999")).cast("int"), F.lit(1))
