import datetime as dt

from colloquary.schemas import CAPTURES, MESSAGES


def at(text):
    return dt.datetime.fromisoformat(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def captures(spark, *items):
    """(key, capture_id, time, state[, value])"""
    return spark.createDataFrame(
        [(k, i, at(t) if t else None, s, v[0] if v else None) for k, i, t, s, *v in items],
        CAPTURES)


def messages(spark, *items):
    """(conv_id, seq, author, text)"""
    return spark.createDataFrame([(None, c, s, a, None, t) for c, s, a, t in items], MESSAGES)
