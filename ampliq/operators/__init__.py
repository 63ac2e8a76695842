"""DataFrame operators: from reads and references to alleles, positions, rates and comparisons."""
