"""Questions in words: what they say about periods, amounts, comparisons, groupings and intent."""
