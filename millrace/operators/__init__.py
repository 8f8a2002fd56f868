"""Operators: DataFrame to DataFrame functions of the conversation layers and of documents."""
