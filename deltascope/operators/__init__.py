"""Transformations of DataFrames: versions, partition, mixes, histograms, failure views, clusters, labels, bytecode."""
