"""Listing tables over the driver's tables: one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"s": "string", "day": "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(n_chars % 120 as int))", "month": "published_at + make_dt_interval(30)", "hours": "make_dt_interval(0, cast({} as int))"}
_DUCK = {"s": "varchar", "day": "timestamp '2024-01-01 00:00:00' + to_days(cast(n_chars % 120 as int))", "month": "published_at + to_days(30)", "hours": "to_hours(cast({} as int))"}

VIEWS = {
    "listing": """select doc_id, source as source_name, cast(substr(source, 4) as int) as source_id, cast(doc_id as {s}) as external_id, substr(text, 1, 60) as title,
      concat('emp', cast(n_chars % 37 as {s})) as employer, text as description, lang, n_chars,
      case n_chars % 6 when 0 then 'Oulu' when 1 then 'Helsinki / Etä' when 2 then 'Helsinki / Hybridi' when 3 then 'Suomi' when 4 then 'Ylivieska' else 'Helsinki, Kuopio, Oulu' end as location,
      {day} as published_at from documents""",
    "job": """select doc_id as job_id, source_name, source_id, external_id, title, employer, description, location, lang, n_chars, published_at,
      case when doc_id % 3 = 0 then {month} end as expires_at, case when doc_id % 11 = 0 then 'removed' else 'active' end as status from listing""",
    "source_dim": """select distinct source_id, source_name, source_id % 7 <> 0 as enabled from listing""",
    "feedback": """select event_id as feedback_id, user_id % 5 as profile_id, event_id % (select count(*) from documents) as job_id, ts as created_at,
      case event_type when 'purchase' then 5 when 'signup' then 5 when 'click' then 4 when 'view' then 3 else 1 end as rating, event_type = 'purchase' as applied from events""",
    "rec": """select doc_id as rec_id, doc_id % 3 as profile_id, doc_id as job_id, n_chars % 101 as machine_score, case when doc_id % 4 = 0 then null else (n_chars * 7) % 101 end as review_score,
      case n_chars % 5 when 0 then 'skip' when 1 then 'consider' else 'apply' end as action, n_chars % 6 in (0, 5) as commutable, n_chars % 6 = 1 as remote, doc_id % 13 = 0 as hard_rejected, lang as lane
      from documents""",
    "scan": """select event_id, user_id as source_id, ts, case event_type when 'error' then 'missing' when 'view' then 'classified' else 'invalid' end as outcome from events""",
    "profile_term": """select distinct item_id as profile_id, term from (select item_id, {terms} as term from benchmark) x where length(term) >= 6""",
}
_TERMS = {"spark": "explode(regexp_extract_all(lower(text), '[0-9a-zåäö]+', 0))", "duck": "unnest(regexp_extract_all(lower(text), '[0-9a-zåäö]+'))"}


class Tables:
    """Tables of one folder by name: the driver's, and VIEWS over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                text = VIEWS[name].format(**_SPARK, terms=_TERMS["spark"])
                used = {x: getattr(self, x) for x in _names(text)}
                for x in used:
                    text = re.sub(rf"\b(from|join) {x}\b", rf"\1 {{{x}}}", text)
                self._made[name] = self.spark.sql(text, **used)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\b(?:from|join) (\w+)", text)))


def duck(sql: str) -> str:
    """A DuckDB statement with the views that it uses in front."""
    views: dict[str, str] = {}

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+(\w+)", text, re.I):
            if name in VIEWS and name not in views:
                body = VIEWS[name].format(**_DUCK, terms=_TERMS["duck"])
                need(body)
                views[name] = body

    need(sql)
    if not views:
        return sql
    heads = ", ".join(f"{k} as ({v})" for k, v in views.items())
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {heads}, {body[15:]}"
    return f"with {heads}, {body[5:]}" if body[:5].lower() == "with " else f"with {heads} {body}"
