"""Training-data operators: each module holds one operator with its own general interface;
``queries`` holds the registered queries and the SQL they are checked against."""
