"""DataFrame transformations: intervals, frames, words, clusters, renderings, batches."""
