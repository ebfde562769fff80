"""Change-impact analytics on Spark: what replaying transactions under another price schedule does to them."""
