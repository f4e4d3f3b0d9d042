"""The fixed values, a second time: a slip in one place shows."""

import pytest

from prioscope import config

# Fixed values, in the order of the settings.
VALUES = {
    "COLUMN_ALIASES": {'ticket_id': ('Ticket ID', 'ticket_id', 'id', 'ID', 'TicketID'),
     'subject': ('Ticket Subject', 'Subject', 'subject', 'title', 'Title'),
     'description': ('Ticket Description', 'Description', 'description', 'body', 'Body', 'message',
                     'Message'),
     'priority': ('Ticket Priority', 'Priority', 'priority', 'Priority_Level', 'urgency',
                  'Urgency'),
     'ticket_type': ('Ticket Type', 'Type', 'type', 'ticket_type', 'Category', 'category',
                     'Issue_Category'),
     'status': ('Ticket Status', 'Status', 'status'),
     'channel': ('Ticket Channel', 'Channel', 'channel', 'source', 'Source'),
     'resolution': ('Resolution', 'resolution', 'resolution_text', 'Solution'),
     'customer_name': ('Customer Name', 'Name', 'customer_name'),
     'product': ('Product Purchased', 'Product', 'product'),
     'csat': ('Customer Satisfaction Rating', 'CSAT', 'csat', 'satisfaction_rating', 'Rating',
              'Satisfaction_Score'),
     'first_response': ('First Response Time', 'first_response_time', 'response_time'),
     'resolution_time': ('Time to Resolution', 'resolution_time', 'time_to_resolution',
                         'handle_time', 'Resolution_Time_Hours'),
     'date_purchased': ('Date of Purchase', 'date_purchased', 'purchase_date')},
    "REQUIRED_COLUMNS": ('subject', 'description', 'priority'),
    "NA_TOKENS": ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
     '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'),
    "LEVELS": ('low', 'medium', 'high', 'critical'),
    "LEVEL_RANK": {'low': 0, 'medium': 1, 'high': 2, 'critical': 3},
    "BAND_UPPER": (('low', 0.3), ('medium', 0.55), ('high', 0.78), ('critical', 1.01)),
    "PRIORITY_WORDS": {'critical': 'critical|urgent|emergency|p0|p1|sev1|severity[\\s\\-]?1',
     'high': 'high|hi|p2|sev2|severity[\\s\\-]?2',
     'medium': 'medium|med|moderate|p3|sev3|severity[\\s\\-]?3',
     'low': 'low|lo|minor|p4|p5|sev4|sev5|severity[\\s\\-]?[45]'},
    "CRITICAL_PHRASES": ('system down', 'complete outage', 'total failure', 'data loss', 'data breach',
     'security breach', 'cannot access', 'unable to access', 'entirely broken', 'production down',
     'server down', 'database down', 'payment failing', 'all users affected', 'critical error',
     'emergency', 'urgent help', 'immediately', 'asap', 'as soon as possible', 'losing data',
     'corrupted', 'company halted', 'business stopped', 'cannot function', 'security vulnerability',
     'ransomware', 'unauthorized access', 'credentials stolen', 'severe impact',
     'multiple users affected', 'revenue loss', 'sla breach', 'deadline missed'),
    "HIGH_PHRASES": ('not working', 'broken', 'major issue', 'significant problem', 'disrupted', 'keeps failing',
     'repeated failure', 'very slow', 'severely degraded', 'several users', 'team affected',
     'functionality lost', 'error repeatedly', 'blocked', 'cannot complete', 'overdue', 'escalate',
     'need urgent', 'frustrated', 'unacceptable', 'very disappointed', 'angry'),
    "MEDIUM_PHRASES": ('problem', 'issue', 'error', 'bug', 'glitch', 'not responding', 'sometimes fails',
     'intermittent', 'slow', 'delayed', 'minor disruption', 'unexpected behavior', 'wrong result',
     'incorrect', 'workaround needed'),
    "LOW_PHRASES": ('question', 'inquiry', 'how to', 'wondering', 'could you please', 'request for information',
     'general question', 'curious', 'help me understand', 'feature request', 'enhancement',
     'suggestion', 'when will', 'nice to have', 'minor', 'cosmetic', 'typo', 'spelling'),
    "NEGATION_WORDS": ('not', 'no', 'never', 'cannot', "can't", "won't", "doesn't", "didn't", "isn't", "aren't",
     "wasn't", "weren't", 'nothing', 'nowhere', 'nobody'),
    "LABEL_PROBABILITY_WEIGHTS": {'p_critical': 1.0, 'p_high': 0.67, 'p_medium': 0.33, 'p_low': 0.0},
    "STRUCTURAL_FEATURES": ('text_length', 'word_count', 'exclamation_count', 'question_count', 'caps_ratio', 'csat_norm',
     'csat_inverted', 'first_response_minutes_norm', 'resolution_time_minutes_norm', 'channel_enc',
     'ticket_type_enc', 'status_enc', 'inferred_severity_score', 'severity_confidence',
     'urgency_lexicon_score'),
}


@pytest.mark.parametrize("name", VALUES)
def test_fixed_values(name):
    assert getattr(config, name) == VALUES[name]
