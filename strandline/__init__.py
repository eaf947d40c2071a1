"""strandline: sequencing reads, seeds, alignments, pileups and variants as Spark DataFrames."""
