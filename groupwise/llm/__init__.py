"""Training-data operators: packing, similarity joins, scanning, encoding, media, search and archives."""
