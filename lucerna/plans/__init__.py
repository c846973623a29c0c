"""Registered queries: name -> callable(spark, sf_dir), and the SQL each must equal."""
