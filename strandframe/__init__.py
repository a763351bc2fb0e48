"""Genomic intervals, sequences and motifs as Spark DataFrames."""
