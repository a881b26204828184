"""Building blocks the operators share: periods, record selection, dense series, shares."""
