"""Text-to-position analytics on Spark: who said what about which item, and where that puts them."""
