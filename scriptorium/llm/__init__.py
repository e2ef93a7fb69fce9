"""Training-data operators: each module holds one operator, its thin ``opN_<name>`` query and, where one exists, its SQL."""
