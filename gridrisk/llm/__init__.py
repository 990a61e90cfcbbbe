"""Training-data operators: filtering, de-duplication, privacy, packing, sharding and token files."""
