"""Tables, and the retail panel that is made of them."""
