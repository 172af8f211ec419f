"""tessera: follower-graph analytics as plain PySpark DataFrame plans."""
