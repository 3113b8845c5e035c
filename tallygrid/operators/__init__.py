"""DataFrame in, DataFrame out: derive, fill, summarise, cut and lay out."""
