"""Training-data operators: cleaning, de-duplication, mixing, packing and output."""
