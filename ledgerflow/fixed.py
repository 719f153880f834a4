"""Fixed values the results depend on.

FIXED VALUES — these must equal the planning workbook's own names, lists and
constants for the results to be right. They are data, kept together here in
their natural order; the logic that uses them lives in ``operators/``.
"""

from __future__ import annotations

# --- constants -------------------------------------------------------------
BANK_CHARGE = 0.001            # share withheld by the bank on export proceeds
RATIO_SCALE = 100.0            # split is amount / ratio * 100
YEARLY_SHIPMENT_TARGET = 8400000.0
DEFAULT_SETTINGS = {"usd_rate": 84.5, "cf_date": "1996-01-01",
                    "yearly_shipment_qty_akl": YEARLY_SHIPMENT_TARGET}
CHECK_MESSAGE = "Check File"
GATE_MESSAGE_SHORT = "Shipment Tergate is not Fullfill, do you wnat to import?"
GATE_MESSAGE_OK = "OK, do you want to import?"
LINE_ID_FORMAT = "CFRL%04d"
COLUMN_ID_FORMAT = "CFC%05d"
OPENING_SHIFT_DAYS = 7

# --- the five accounts an export receipt is split over ----------------------
# (ratio field on the bank, report description of its weekly proceeds)
ACCOUNTS = [
    ("margin", "Sales Proceeds - Margin A/C"),
    ("bildup_unifill", "Sales Proceeds - Build up (Unifil payment)"),
    ("erq", "Sales Proceeds - ERQ A/C"),
    ("bildup_machine", "Sales Proceeds - Build Up A/C (Machinery payment)"),
    ("bildup_regular", "Sales Proceeds - Build Up A/C (Regular)"),
]
RATIO_FIELDS = [a for a, _ in ACCOUNTS]

# --- closed option lists of the ledgers --------------------------------------
INCOME_ACCOUNTS = ["Export Income", "Other Income"]
INCOME_FORECAST_HEADS = [
    "Transfer in from ERQ/Margin/Buildup", "Cash Incentive", "Other Inflow",
    "Jhute and others Sales in Bank", "Sub-Contract Income", "Received in CD A/C as STL/LTL",
    "Received in CD as OD", "Received in CD A/C as PSF/PC Loan", "Received from AKL (Inter Co.)",
    "Received from AKL (STL)", "Received in Mother Account", "Received in Welfare Account",
    "Received in Salary Account", "Received in  Zakat Account", "Increased OD Account",
    "Bank Charge/Interest Expenses (OD A/C)", "Received in L/O Account Cash",
    "Sales Proceeds - Margin A/C", "Sales Proceeds - Build up (Unifil payment)",
    "Sales Proceeds - ERQ A/C", "Sales Proceeds - Build Up A/C (Machinery payment)",
    "Sales Proceeds - Build Up A/C (Regular)", "Other Inflow - Margin A/C",
    "Transfer in ERQ A/C from build up/others",
]
INCOME_ACTUAL_HEADS = [
    "Transfer in from ERQ/Margin/Buildup", "USD Sales from build up account", "Cash Incentive",
    "Other Inflow", "Received in L/O Account Bank", "Sub-Contract Income",
    "Received in CD A/C as STL/LTL", "Received in CD as OD", "Received in CD A/C as PSF/PC Loan",
    "Received from AKL (Inter Co.)", "Received from AKL (STL)", "Received in Mother Account",
    "Received in Welfare Account", "Received in Salary Account", "Received in  Zakat Account",
    "Increased OD Account", "Bank Charge/Interest Expenses (OD A/C)",
    "Received in L/O Account Cash", "Sales Proceeds - Margin A/C",
    "Sales Proceeds - Build up (Unifil payment)", "Sales Proceeds - ERQ A/C",
    "Sales Proceeds - Build Up A/C (Machinery payment)", "Sales Proceeds - Build Up A/C (Regular)",
    "Other Inflow - Margin A/C", "Transfer in ERQ A/C from build up/others",
]
EXPENSE_HEADS = [
    "Other operational expenses", "Settled Salary", "Salary and Allowances",
    "Salary and Allowances", "Meal & Tiffin Expenses", "Operational Payments",
    "Other Processing Charge", "C & F Charge", "Freight & Transport",
    "Boiler & Generator Running Expenses", "Factory Compliance", "Repair & Maintenance - Factory",
    "Repair & Maintenance- Factory Machine", "Construction & Development", "Factory Rent",
    "Electricity Charge", "Gas Charge", "Documentation & Processing Charge", "Technical Know How",
    "Lab Test", "Insurance Settlement", "Chemical Expenses", "Bank Charge", "Special Charge",
    "Courier(Bulk & Post Order)", "Safety & Health Care- Direct", "Travel Expenses",
    "Administrative Salary", "CRP Child Care Food Scholarship Security Other Bonus",
    "Office Transportation Expenses", "Rent/Rates/Taxes", "Printing & Stationary", "AIT & VAT",
    "Advertising & Business Promotion", "Repair & Maintenence-Office", "Telephone/Fax/Internet",
    "Training & Recruitment Expenses", "Entertainment Expenses", "Audit & Accountancy",
    "Legal & Professional Expenses", "Research & Development", "Security Expenses",
    "Sales Commission & Others", "Canteen Subsidy", "Float payment", "Yearly Conference",
    "Donation", "Remuneration", "PF Contribution", "Extra over time", "Air Freight",
    "Sub contract charge", "Finance charge", "Director Sir personal", "MD Sir personal",
    "Incentive", "Petty Cash", "Bonus", "Advance Salary/Wages", "Head Office Payments", "Capex",
    "LC Payment from margin A/C", "Transfer to CD for extra event from Margin A/C",
    "Transfer to CD for extra event from build up A/C", "LC Payment for Unifill from build up A/C",
    "Early Settlement(EDF-LC) from margin A/C", "TT Payment from ERQ A/C",
    "Foreign Bank Charges from sales proceed", "Source Tax & CRF",
    "USD encashment for CD from build up A/C", "LC Payment for Machinery from build up A/C",
    "Transfer out from build up/others to ERQ", "Payment to AKL (Inter Co.)",
    "Payment to AKL (STL)", "Lock Investment from CD", "Loan Settlement (STL/LTL)",
    "Loan Settlement (QSF Loan)", "Loan Settlement (PSF / PC)", "Settlement of O/D loan from CD",
    "Payment from Salary Account", "Payment from Welfare Account", "Payment from Zakat Account",
    "Payment from L/O Bank Account", "Payment from L/O Cash Account",
    "Transfer out as contra Salary A/c from Mother A/C", "Decreased OD Account",
    "Expense ERQ/MARGIN",
]
EXPENSE_ACCOUNTS = [
    "Direct/Indirect Wages", "Staff salaries", "EOT", "Advance Salaries/ Wages", "Bonus",
    "Air Freight", "Sub Con Payment", "Capex", "Bank Charge(Commercial)", "Bank Interest",
    "Other Expenses", "Payment to AKL (Inter Co.)", "Payment to AKL (STL)",
    "Lock Investment from CD", "Loan Settlement (STL/LTL)", "Loan Settlement (QSF Loan)",
    "Loan Settlement (PSF / PC)", "Settlement of O/D loan from CD", "Payment from Salary Account",
    "Payment from Welfare Account", "Payment from Zakat Account", "Payment from L/O Bank Account",
    "Payment from L/O Cash Account", "Transfer out as contra Salary A/c from Mother A/C",
    "Decreased OD Account", "Expense ERQ/MARGIN",
]
CURRENCIES = ["BDT", "USD"]
COLUMN_STATUSES = ["Projected", "Actual"]
SHIPMENT_TYPES = ["Projected", "Actual"]
# declared cash ledgers
CF_INFLOW_TYPES = ["Actual", "Projected"]
CF_OUTFLOW_TYPES = ["Actual Expenses", "SUMMARY ERQ/MARGIN"]
CF_OUTFLOW_ACCOUNTS = ["BDT", "USD"]
# defaults of fields left empty
DEFAULT_CURRENCY, DEFAULT_UNIT = "BDT", "USD"
RECORD_STATUSES = ["Active", "Inactive"]
REPORT_NAMES = ["CURRENT ACCOUNT CASHFLOW", "ERQ/MARGIN CASHFLOW"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- upload headers -> table fields (snapshot import) -------------------------
FORECAST_UPLOAD_FIELDS = [
    ("Buyer", "buyer"), ("Style", "style"), ("PO Qty", "order_qty"), ("FOB/PC", "fob_price"),
    ("Team", "team"), ("OC", "oc"), ("PO No", "po_no"), ("Color", "color"),
    ("PO Qty", "po_qty"), ("Shipped Qty", "shipped_qty"), ("Ex-Fty Date", "exfty_date"),
]
BILLS_UPLOAD_FIELDS = [
    ("Buyer", "buyer"), ("STYLE NO", "style_no"), ("QTY-PCS", "qty_pcs"),
    ("UNIT PRICE", "unit_price"), ("Invoice", "invoice"), ("PO NO", "po_no"),
    ("EX-FTY DATE", "ex_fty_date"),
]
FORECAST_QTY_HEADER = "PO Qty"
BILLS_QTY_HEADER = "QTY-PCS"

# --- regions of the planning workbook: table, sheet, header row, first and last data row
# (last excluded, counted from the row after the header), quarter columns dropped,
# first column kept, first value column among those kept. Fixed values.
SHEET_REGIONS = [
    ("actual_expenses", "Act Expenses", 67, 0, 12, False, 2, 3),
    ("actual_expense_SUMMARY_ERQ_MARGIN", "Act Expenses", 95, 0, 25, True, 2, 3),
    ("Expense_Summary_CD_SOD", "Proj. Expenses income", 64, 0, 25, True, 2, 3),
    ("Expense_Summary_ERQ_MARGIN", "Proj. Expenses income", 93, 0, 11, True, 2, 3),
    ("budget_exp", "Proj. Expenses income", 108, 1, 20, True, 2, 3),
    ("bank_balance", "Bank Balance & Others", 2, 2, 6, True, 0, 4),
    ("cash_inflow_projection_from_export", "Bank Balance & Others", 2, 12, 22, True, 0, 4),
    ("actual_export", "Bank Balance & Others", 2, 85, 88, True, 0, 4),
    ("cash_inflow_from_other_sources", "Bank Balance & Others", 98, 1, 19, False, 0, 4),
]
# headers as the workbook has them, and the names the loaders give them
SHEET_HEADER_NAMES = {"Summary": "Description", "Unnamed: 2": "Description", "Unnamed: 3": "Unit"}

# --- report base-cell rules, in ladder order ---------------------------------
# (column status, report line, source view, match column, key or None = line name)
# Sources: income_forecast, income_actual, expenses_forecast, expenses_actual,
# shipments_qty, shipments_fob, final_proj_income. Match column: head | account.
_IF, _IA, _EF, _EA = "income_forecast", "income_actual", "expenses_forecast", "expenses_actual"
_FP = "final_proj_income"
RULES = [
    ("Projected", "Transfer in from ERQ/Margin/Buildup", _IF, "head", None),
    ("Projected", "USD Sales from build up account", _FP, "head", "Sales Proceeds - Build Up A/C (Regular)"),
    ("Projected", "Cash Incentive", _IF, "head", None),
    ("Projected", "Other Inflow", _IF, "head", None),
    ("Projected", "Received in L/O Account Bank", _IF, "head", None),
    ("Projected", "Sub-Contract Income", _IF, "head", None),
    ("Projected", "Received in CD A/C as STL/LTL", _IF, "head", None),
    ("Projected", "Received in CD as OD", _IF, "head", None),
    ("Projected", "Received in CD A/C as PSF/PC Loan", _IF, "head", None),
    ("Projected", "Received from AKL (Inter Co.)", _IF, "head", None),
    ("Projected", "Received from AKL (STL)", _IF, "head", None),
    ("Projected", "Received in Mother Account", _IF, "head", None),
    ("Projected", "Received in Welfare Account", _IF, "head", None),
    ("Projected", "Received in Salary Account", _IF, "head", None),
    ("Projected", "Received in Zakat Account", _IF, "head", None),
    ("Projected", "Increased OD Account", _IF, "head", None),
    ("Projected", "Bank Charge/Interest Expenses (OD A/C)", _IF, "head", None),
    ("Projected", "Received in L/O Account Cash", _IF, "head", None),
    ("Projected", "Direct/Indirect Wages", _EF, "account", None),
    ("Projected", "Staff salaries", _EF, "account", None),
    ("Projected", "EOT", _EF, "account", None),
    ("Projected", "Advance Salaries/ Wages", _EF, "account", None),
    ("Projected", "Bonus", _EF, "account", None),
    ("Projected", "Air Freight", _EF, "account", None),
    ("Projected", "Sub Con/Reprocessing payment", _EF, "account", "Sub Con Payment"),
    ("Projected", "Capital Expenditure", _EF, "account", "Capex"),
    ("Projected", "Bank Charge (Mother A/C)", _EF, "head", "Bank Charge(Commercial)"),
    ("Projected", "Finance/Interest Expenses (Mother A/C)", _EF, "head", None),
    ("Projected", "Other Expenses", _EF, "account", None),
    ("Projected", "Payment to AKL (Inter Co.)", _EF, "head", None),
    ("Projected", "Payment to AKL (STL)", _EF, "head", None),
    ("Projected", "Lock Investment from CD", _EF, "head", None),
    ("Projected", "Loan Settlement (STL/LTL)", _EF, "head", None),
    ("Projected", "Loan Settlement (QSF Loan)", _EF, "head", None),
    ("Projected", "Loan Settlement (PSF / PC)", _EF, "head", None),
    ("Projected", "Settlement of O/D loan from CD", _EF, "head", None),
    ("Projected", "Payment from Salary Account", _EF, "head", None),
    ("Projected", "Payment from Welfare Account", _EF, "head", None),
    ("Projected", "Payment from Zakat Account", _EF, "head", None),
    ("Projected", "Payment from L/O Bank Account", _EF, "head", None),
    ("Projected", "Payment from L/O Cash Account", _EF, "head", None),
    ("Projected", "Transfer out as contra Salary A/c from Mother A/C", _EF, "head", None),
    ("Projected", "Decreased OD Account", _EF, "head", None),
    ("Projected", "Sales Proceeds - Margin A/C", _FP, "head", None),
    ("Projected", "Sales Proceeds - Build up (Unifil payment)", _FP, "head", None),
    ("Projected", "Sales Proceeds - ERQ A/C", _FP, "head", None),
    ("Projected", "Sales Proceeds - Build Up A/C (Machinery payment)", _FP, "head", None),
    ("Projected", "Sales Proceeds - Build Up A/C (Regular)", _FP, "head", None),
    ("Projected", "Other Inflow - Margin A/C", _FP, "head", None),
    ("Projected", "Transfer in ERQ A/C from build up/others", _FP, "head", None),
    ("Projected", "LC Payment from margin A/C", _EF, "head", None),
    ("Projected", "Transfer to CD for extra event from Margin A/C", _EF, "head", None),
    ("Projected", "Transfer to CD for extra event from build up A/C", _EF, "head", None),
    ("Projected", "LC Payment for Unifill from build up A/C", _EF, "head", None),
    ("Projected", "Early Settlement(EDF-LC) from margin A/C", _EF, "head", None),
    ("Projected", "TT Payment from ERQ A/C", _EF, "head", None),
    ("Projected", "Foreign Bank Charges from sales proceed", _EF, "head", None),
    ("Projected", "Source Tax & CRF", _EF, "head", None),
    ("Projected", "USD encashment for CD from build up A/C", _EF, "head", None),
    ("Projected", "LC Payment for Machinery from build up A/C ", _EF, "head", None),
    ("Projected", "Transfer out from build up/others to ERQ", _EF, "head", None),
    ("Actual", "Shipped Qty", "shipments_qty", "head", None),
    ("Actual", "Shipped FOB", "shipments_fob", "head", None),
    ("Actual", "Transfer in from ERQ/Margin/Buildup", _IA, "head", None),
    ("Actual", "USD Sales from build up account", _IA, "head", None),
    ("Actual", "Cash Incentive", _IA, "head", None),
    ("Actual", "Other Inflow", _IA, "head", None),
    ("Actual", "Sub-Contract Income", _IA, "head", None),
    ("Actual", "Received in CD A/C as STL/LTL", _IA, "head", None),
    ("Actual", "Received in CD as OD", _IA, "head", None),
    ("Actual", "Received in CD A/C as PSF/PC Loan", _IA, "head", None),
    ("Actual", "Received from AKL (Inter Co.)", _IA, "head", None),
    ("Actual", "Received from AKL (STL)", _IA, "head", None),
    ("Actual", "Received in Mother Account", _IA, "head", None),
    ("Actual", "Received in Welfare Account", _IA, "head", None),
    ("Actual", "Received in Salary Account", _IA, "head", None),
    ("Actual", "Received in  Zakat Account", _IA, "head", None),
    ("Actual", "Increased OD Account", _IA, "head", None),
    ("Actual", "Bank Charge/Interest Expenses (OD A/C)", _IA, "head", None),
    ("Actual", "Received in L/O Account Cash", _IA, "head", None),
    ("Actual", "Direct/Indirect Wages", _EA, "account", None),
    ("Actual", "Staff salaries", _EA, "account", None),
    ("Actual", "EOT", _EA, "head", None),
    ("Actual", "Advance Salaries/ Wages", _EA, "account", None),
    ("Actual", "Bonus", _EA, "account", None),
    ("Actual", "Air Freight", _EA, "account", None),
    ("Actual", "Sub Con/Reprocessing payment", _EA, "account", "Sub Con Payment"),
    ("Actual", "Capital Expenditure", _EA, "account", "Capex"),
    ("Actual", "Bank Charge (Mother A/C)", _EA, "account", "Bank Charge(Commercial)"),
    ("Actual", "Finance/Interest Expenses (Mother A/C)", _EA, "account", "Bank Interest"),
    ("Actual", "Other Expenses", _EA, "account", None),
    ("Actual", "Payment to AKL (Inter Co.)", _EA, "head", None),
    ("Actual", "Payment to AKL (STL)", _EA, "head", None),
    ("Actual", "Lock Investment from CD", _EA, "head", None),
    ("Actual", "Loan Settlement (STL/LTL)", _EA, "head", None),
    ("Actual", "Loan Settlement (QSF Loan)", _EA, "head", None),
    ("Actual", "Loan Settlement (PSF / PC)", _EA, "head", None),
    ("Actual", "Settlement of O/D loan from CD", _EA, "head", None),
    ("Actual", "Payment from Salary Account", _EA, "head", None),
    ("Actual", "Payment from Welfare Account", _EA, "head", None),
    ("Actual", "Payment from Zakat Account", _EA, "head", None),
    ("Actual", "Payment from L/O Bank Account", _EA, "head", None),
    ("Actual", "Payment from L/O Cash Account", _EA, "head", None),
    ("Actual", "Transfer out as contra Salary A/c from Mother A/C", _EA, "account", None),
    ("Actual", "Decreased OD Account", _EA, "account", None),
    ("Actual", "Sales Proceeds - Margin A/C", _IA, "head", None),
    ("Actual", "Sales Proceeds - Build up (Unifil payment)", _IA, "head", None),
    ("Actual", "Sales Proceeds - ERQ A/C", _IA, "head", None),
    ("Actual", "Sales Proceeds - Build Up A/C (Machinery payment)", _IA, "head", None),
    ("Actual", "Sales Proceeds - Build Up A/C (Regular)", _IA, "head", None),
    ("Actual", "Other Inflow - Margin A/C", _IA, "head", None),
    ("Actual", "Transfer in ERQ A/C from build up/others", _IA, "head", None),
    ("Actual", "LC Payment from margin A/C", _EA, "head", None),
    ("Actual", "Transfer to CD for extra event from Margin A/C", _EA, "head", None),
    ("Actual", "Transfer to CD for extra event from build up A/C", _EA, "head", None),
    ("Actual", "LC Payment for Unifill from build up A/C", _EA, "head", None),
    ("Actual", "Early Settlement(EDF-LC) from margin A/C", _EA, "head", None),
    ("Actual", "TT Payment from ERQ A/C", _EA, "head", None),
    ("Actual", "Foreign Bank Charges from sales proceed", _EA, "head", None),
    ("Actual", "Source Tax & CRF", _EA, "head", None),
    ("Actual", "USD encashment for CD from build up A/C", _EA, "head", None),
    ("Actual", "LC Payment for Machinery from build up A/C ", _EA, "head", None),
    ("Actual", "Transfer out from build up/others to ERQ", _EA, "head", None),
]
# Rules whose sum is rescaled: (status, line) -> multiply by usd_rate / 1000.
USD_PER_THOUSAND_RULES = [("Projected", "USD Sales from build up account")]

# --- report lines: (id number, report, group, line name, unit) ----------------
_CUR, _USD = REPORT_NAMES
REPORT_LINES = [
    (118, _CUR, "0", "Shipped Qty", "PCS"),
    (119, _CUR, "0", "Shipped FOB", "USD"),
    (120, _CUR, "1", "Opening Balance Left Over Bank A/C", "BDT"),
    (121, _CUR, "1", "Opening Balance Left Over Cash A/C", "BDT"),
    (122, _CUR, "1", "Opening Balance Welfare A/C", "BDT"),
    (123, _CUR, "1", "Opening Balance Zakat Fund", "BDT"),
    (124, _CUR, "1", "Opening Balance Salary A/C", "BDT"),
    (125, _CUR, "1", "Opening Balance Mother Accounts", "BDT"),
    (126, _CUR, "1", "Opening Balance OD Accounts", "BDT"),
    (127, _CUR, "1", "Total Opening Balance", "BDT"),
    (128, _CUR, "2", "Transfer in from ERQ/Margin/Buildup", "BDT"),
    (129, _CUR, "2", "USD Sales from build up account", "BDT"),
    (130, _CUR, "2", "Cash Incentive", "BDT"),
    (131, _CUR, "2", "Other Inflow", "BDT"),
    (132, _CUR, "2", "Received in L/O Account Bank", "BDT"),
    (133, _CUR, "2", "Sub-Contract Income", "BDT"),
    (134, _CUR, "2", "Received in CD A/C as STL/LTL", "BDT"),
    (135, _CUR, "2", "Received in CD as OD", "BDT"),
    (136, _CUR, "2", "Received in CD A/C as PSF/PC Loan", "BDT"),
    (137, _CUR, "2", "Received from AKL (Inter Co.)", "BDT"),
    (138, _CUR, "2", "Received from AKL (STL)", "BDT"),
    (139, _CUR, "2", "Received in Mother Account", "BDT"),
    (140, _CUR, "2", "Received in Welfare Account", "BDT"),
    (141, _CUR, "2", "Received in Salary Account", "BDT"),
    (142, _CUR, "2", "Received in Zakat Account", "BDT"),
    (143, _CUR, "2", "Increased OD Account", "BDT"),
    (144, _CUR, "2", "Bank Charge/Interest Expenses (OD A/C)", "BDT"),
    (145, _CUR, "2", "Received in L/O Account Cash", "BDT"),
    (146, _CUR, "2", "Total inflow - Export", "BDT"),
    (147, _CUR, "2", "Total inflow - Bank Loan", "BDT"),
    (148, _CUR, "2", "Total inflow - Others", "BDT"),
    (149, _CUR, "2", "Total inflow - Contra", "BDT"),
    (150, _CUR, "3", "Direct/Indirect Wages", "BDT"),
    (151, _CUR, "3", "Staff salaries", "BDT"),
    (152, _CUR, "3", "EOT", "BDT"),
    (153, _CUR, "3", "Advance Salaries/ Wages", "BDT"),
    (154, _CUR, "3", "Bonus", "BDT"),
    (155, _CUR, "3", "Air Freight", "BDT"),
    (156, _CUR, "3", "Sub Con/Reprocessing payment", "BDT"),
    (157, _CUR, "3", "Capital Expenditure", "BDT"),
    (158, _CUR, "3", "Bank Charge (Mother A/C)", "BDT"),
    (159, _CUR, "3", "Finance/Interest Expenses (Mother A/C)", "BDT"),
    (160, _CUR, "3", "Other Expenses", "BDT"),
    (161, _CUR, "3", "Payment to AKL (Inter Co.)", "BDT"),
    (162, _CUR, "3", "Payment to AKL (STL)", "BDT"),
    (163, _CUR, "3", "Lock Investment from CD", "BDT"),
    (164, _CUR, "3", "Loan Settlement (STL/LTL)", "BDT"),
    (165, _CUR, "3", "Loan Settlement (QSF Loan)", "BDT"),
    (166, _CUR, "3", "Loan Settlement (PSF / PC)", "BDT"),
    (167, _CUR, "3", "Settlement of O/D loan from CD", "BDT"),
    (168, _CUR, "3", "Payment from Salary Account", "BDT"),
    (169, _CUR, "3", "Payment from Welfare Account", "BDT"),
    (170, _CUR, "3", "Payment from Zakat Account", "BDT"),
    (171, _CUR, "3", "Payment from L/O Bank Account", "BDT"),
    (172, _CUR, "3", "Payment from L/O Cash Account", "BDT"),
    (173, _CUR, "3", "Transfer out as contra Salary A/c from Mother A/C", "BDT"),
    (174, _CUR, "3", "Decreased OD Account", "BDT"),
    (175, _CUR, "3", "Total Out-flow - Operation", "BDT"),
    (176, _CUR, "3", "Total Out-flow - Salary & wages", "BDT"),
    (177, _CUR, "3", "Total Out-flow - Loan", "BDT"),
    (178, _CUR, "3", "Total Out-flow - Investment", "BDT"),
    (179, _CUR, "3", "Total Out-flow - bank Interest", "BDT"),
    (180, _CUR, "3", "Total Out-flow - EOT", "BDT"),
    (181, _CUR, "3", "Total Out-flow - Air Freight", "BDT"),
    (182, _CUR, "3", "Total Out-flow - Sub Con/Reprocessing charge", "BDT"),
    (183, _CUR, "3", "Total cash outflow (Salary & Operation)", "BDT"),
    (184, _CUR, "3", "Total Out-flow - Contra", "BDT"),
    (185, _CUR, "4", "Closing Balance Left Over (Bank A/C)", "BDT"),
    (186, _CUR, "4", "Closing Balance Left Over (Cash A/C)", "BDT"),
    (187, _CUR, "4", "Closing Balance Welfare A/C", "BDT"),
    (188, _CUR, "4", "Closing Balance Zakat Fund", "BDT"),
    (189, _CUR, "4", "Closing Balance Salary A/C", "BDT"),
    (190, _CUR, "4", "Closing Balance Mother A/C", "BDT"),
    (191, _CUR, "4", "Closing Balance OD", "BDT"),
    (192, _CUR, "4", "Total Closing Balance", "BDT"),
    (193, _USD, "5", "Opening Balance Margin A/C", "USD"),
    (194, _USD, "5", "Opening Balance Build up (Unifil payment)", "USD"),
    (195, _USD, "5", "Opening Balance ERQ A/C", "USD"),
    (196, _USD, "5", "Opening Balance Build Up A/C (Machinery payment)", "USD"),
    (197, _USD, "5", "Opening Balance Build Up A/C (Regular)", "USD"),
    (198, _USD, "5", "Total Opening Balance", "USD"),
    (199, _USD, "6", "Sales Proceeds - Margin A/C", "USD"),
    (200, _USD, "6", "Sales Proceeds - Build up (Unifil payment)", "USD"),
    (201, _USD, "6", "Sales Proceeds - ERQ A/C", "USD"),
    (202, _USD, "6", "Sales Proceeds - Build Up A/C (Machinery payment)", "USD"),
    (203, _USD, "6", "Sales Proceeds - Build Up A/C (Regular)", "USD"),
    (204, _USD, "6", "Other Inflow - Margin A/C", "USD"),
    (205, _USD, "6", "Transfer in ERQ A/C from build up/others", "USD"),
    (206, _USD, "6", "Total In-flow", "USD"),
    (207, _USD, "6", "Total In-flow - Contra", "USD"),
    (208, _USD, "7", "LC Payment from margin A/C", "USD"),
    (209, _USD, "7", "Transfer to CD for extra event from Margin A/C", "USD"),
    (210, _USD, "7", "Transfer to CD for extra event from build up A/C", "USD"),
    (211, _USD, "7", "LC Payment for Unifill from build up A/C", "USD"),
    (212, _USD, "7", "Early Settlement(EDF-LC) from margin A/C", "USD"),
    (213, _USD, "7", "TT Payment from ERQ A/C", "USD"),
    (214, _USD, "7", "Foreign Bank Charges from sales proceed", "USD"),
    (215, _USD, "7", "Source Tax & CRF", "USD"),
    (216, _USD, "7", "USD encashment for CD from build up A/C", "USD"),
    (217, _USD, "7", "LC Payment for Machinery from build up A/C ", "USD"),
    (218, _USD, "7", "Transfer out from build up/others to ERQ", "USD"),
    (219, _USD, "7", "Total out-flow from margin - LC / EDF", "USD"),
    (220, _USD, "7", "Total out-flow from ERQ - TT", "USD"),
    (221, _USD, "7", "Total out-flow from build up A/C", "USD"),
    (222, _USD, "7", "Total bank charges", "USD"),
    (223, _USD, "7", "Total out-flow - Contra", "USD"),
    (224, _USD, "8", "Closing Balance Margin A/C", "USD"),
    (225, _USD, "8", "Closing Balance Build up (Unifil payment)", "USD"),
    (226, _USD, "8", "Closing Balance ERQ A/C", "USD"),
    (227, _USD, "8", "Closing Balance Build Up A/C (Machinery payment)", "USD"),
    (228, _USD, "8", "Closing Balance Build Up A/C (Regular)", "USD"),
    (229, _USD, "8", "Total Closing Balance", "USD"),
]

# --- roll-up totals as the workbook lists them (ids as written; the
# "CCFRL" spellings never match a line) ---------------------------------------
# (total line name, [member ids as written])
TOTALS_AS_WRITTEN = [
    ("Total inflow - Export", ["CFRL0129"]),
    ("Total inflow - Bank Loan", ["CCFRL0134", "CFRL0135", "CFRL0136"]),
    ("Total inflow - Others", ["CCFRL0128", "CFRL0130", "CFRL0131", "CFRL0132", "CFRL0133",
                               "CFRL0137", "CFRL0138", "CFRL0145"]),
    ("Total inflow - Contra", ["CCFRL0139", "CFRL0140", "CFRL0141", "CFRL0142", "CFRL0143"]),
    ("Total Opening Balance", ["CCFRL0120", "CCFRL0121", "CCFRL0122", "CCFRL0123", "CCFRL0124",
                               "CCFRL0125", "CCFRL0126"]),
    ("Total Out-flow - Operation", ["CFRL0168", "CFRL0169", "CFRL0170", "CFRL0171", "CFRL0172",
                                    "CFRL0160", "CFRL0161", "CFRL0158"]),
    ("Total Out-flow - Salary & wages", ["CFRL0153", "CFRL0154", "CFRL0150", "CFRL0151"]),
    ("Total Out-flow - Loan", ["CFRL0164", "CFRL0165", "CFRL0166", "CFRL0167"]),
    ("Total Out-flow - Investment", ["CFRL0163", "CFRL0157"]),
    ("Total Out-flow - bank Interest", ["CFRL0159"]),
    ("Total Out-flow - EOT", ["CFRL0152"]),
    ("Total Out-flow - Air Freight", ["CFRL0155"]),
    ("Total Out-flow - Sub Con/Reprocessing charge", ["CFRL0156"]),
    ("Total cash outflow (Salary & Operation)", ["CFRL0175", "CFRL0176", "CFRL0179"]),
    ("Total Out-flow - Contra", ["CFRL0174"]),
    ("Total Closing Balance", ["CCFRL0185", "CCFRL0186", "CCFRL0187", "CCFRL0188", "CCFRL0189",
                               "CCFRL0190", "CCFRL0191"]),
    ("Total Opening Balance", ["CCFRL0193", "CCFRL0194", "CCFRL0195", "CCFRL0196", "CCFRL0197"]),
    ("Total In-flow", ["CCFRL0199", "CCFRL0200", "CCFRL0201", "CCFRL0202", "CCFRL0203",
                       "CCFRL0204", "CCFRL0205"]),
    ("Total In-flow - Contra", ["CCFRL0205"]),
    ("Total out-flow from margin - LC / EDF", ["CCFRL0208", "CCFRL0209", "CCFRL0212"]),
    ("Total out-flow from ERQ - TT", ["CCFRL0213"]),
    ("Total out-flow from build up A/C", ["CCFRL0209", "CCFRL0210", "CCFRL0216", "CCFRL0217"]),
    ("Total bank charges", ["CCFRL0214"]),
    ("Total out-flow - Contra", ["CCFRL0218"]),
    ("Total Closing Balance", ["CFRL0224", "CFRL0225", "CFRL0226", "CFRL0227", "CFRL0228"]),
]

# Closing balances: (closing line id, opening line id, plus ids, minus ids).
CLOSINGS = [
    (185, 120, [132, 133], [171]),
    (186, 121, [145], [172]),
    (187, 122, [140], [169]),
    (188, 123, [142], [170]),
    (189, 124, [141], [150, 152, 154, 168]),
    (190, 125, [128, 129, 130, 131, 134, 135, 136, 137, 138, 139],
     [151, 153, 155, 156, 157, 158, 159, 160, 161, 162, 163, 164, 165, 166, 167, 173]),
    (191, 126, [], [144, 174]),
]
