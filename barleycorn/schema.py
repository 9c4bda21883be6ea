"""Schemas of the tables between the steps."""

ALIGNMENT = "score int, score2 int, ref_begin int, ref_end int, read_begin int, read_end int, ref_end2 int, cigar string"
READS = "sample string, read_id long, header string, dna string, qc string"
CLUSTERS = "sample string, sequence string, abundance long, n0 long, n1 long, nunq long, pval double, birth_pval double, birth_ham int"
SGRNA = "id string, target string, sequence string"
TUMORS = "sample string, target string, barcode string, cells double"
