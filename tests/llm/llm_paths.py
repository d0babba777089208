"""Where the corpus operators' tables are."""

SF = "/root/testdata/sf0.001"
