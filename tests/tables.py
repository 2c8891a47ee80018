"""Names of the test tables, apart from any conftest so that every test module can import them."""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
