"""Declared schemas of the tables the jobs read and write."""

#: Columns of a message log file, in order.
LOG_FILE = "tweet_id long, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id double"
MESSAGE_LOG = "id long, author string, inbound boolean, parent long, created_at string, text string"
THREAD = "thread_id string, brand string, customer_msg string, customer_msg_raw string, brand_replies array<struct<id:long,text:string,text_raw:string>>, customer_turns int, created_at string"
EXEMPLAR = "struct<thread_id:string,customer_msg:string,brand_reply:string,similarity:double,is_deflection:boolean>"
RESPONSE = "key string, model string, prompt string, response string, created_at double"
CLASSIFICATION = "intent string, confidence string, rationale string, secondary_intent string"
DRAFT = "reply string, grounded_in array<string>, uncertain boolean, uncertainty_reason string"
JUDGE = "groundedness string, resolution string, tone_fit string, safety string, would_send boolean, justification string, unsupported_claims array<string>"
