"""Hypergraph analytics and hybrid Huffman coding as Spark DataFrame programs."""
