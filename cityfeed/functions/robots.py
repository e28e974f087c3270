"""What robots.txt files allow."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

EXCERPT = 600


@pandas_udf(BooleanType())
def _allows(text: pd.Series, url: pd.Series, agent: pd.Series) -> pd.Series:
    def ask(t, u, a):
        if t is None or u is None:
            return None
        rules = RobotFileParser()
        rules.parse(t.splitlines())
        return rules.can_fetch(a, u)

    return pd.Series([ask(*x) for x in zip(text, url, agent, strict=True)], dtype="object")


def evaluate(status: Column, body: Column, url: Column, agent: str) -> Column:
    """Struct (result, allowed, excerpt): a 404 allows all, any other status than 200 is an error."""
    allowed = F.when(status == 200, _allows(F.coalesce(body, F.lit("")), url, F.lit(agent))).when(status == 404, True)
    result = F.when(status == 404, "allowed").when(status != 200, "error").when(allowed, "allowed").otherwise("disallowed")
    return F.struct(result.alias("result"), allowed.alias("allowed"), F.when(status == 200, F.substring(body, 1, EXCERPT)).alias("excerpt"))
