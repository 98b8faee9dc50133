"""Call-graph analytics on Spark: typed tables of a code base and composable operators over them."""
