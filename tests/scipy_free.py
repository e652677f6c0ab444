"""Rank correlation for tests."""

import pandas as pd


def spearman(a, b):
    return pd.Series(list(a)).rank().corr(pd.Series(list(b)).rank())
